"""Command line: count tokens in standard input, a file or a directory; show or clear stored counts."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import cached, counting, sinks
from .operators import invalidation as inv
from .plans import methods, registry
from .sources import files, state

#: Model names whose own tokenizer is SentencePiece.
SENTENCEPIECE = ("llama-3.1", "llama-4")
STATE_VARIABLE = "QUILLCOUNT_STATE_DIR"


class UsageError(ValueError):
    """Options that don't go together."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillcount", description="Count tokens in standard input (-), a file or a directory.")
    p.add_argument("path", nargs="?", default=files.STDIN)
    p.add_argument("--model", default="")
    p.add_argument("--vocab-file", default="")
    p.add_argument("--provider", default="all")
    for name in ("all", "json", "tokens", "cache", "no-cache", "cache-verify", "verbose", "no-color", "no-progress"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("-m", "--models", action="store_true")
    p.add_argument("-r", "--recursive", "-d", "--directory", action="store_true")
    p.add_argument("--chars-per-token", type=float, default=4.0)
    p.add_argument("--words-per-token", type=float, default=0.75)
    return p


def validate(o: argparse.Namespace) -> None:
    for bad, said in (
        (o.tokens and o.json, "--tokens and --json cannot be used together"),
        (o.tokens and o.models, "--tokens and --models cannot be used together"),
        (o.tokens and o.all, "--tokens and --all cannot be used together; select one model with --model"),
        (o.cache and o.no_cache, "--cache and --no-cache cannot be used together"),
        (o.cache_verify and not o.cache, "--cache-verify requires --cache"),
        (o.path == files.STDIN and o.recursive, "--recursive requires a directory path; stdin is not a directory"),
        (o.path == files.STDIN and o.cache, "--cache is only supported for recursive directory counts"),
        (not registry.valid_provider(o.provider), f"invalid provider {o.provider!r}, valid options: {', '.join(registry.PROVIDERS)}"),
    ):
        if bad:
            raise UsageError(said)


def _store(spark: SparkSession) -> state.ParquetStore:
    return state.ParquetStore(spark, os.environ.get(STATE_VARIABLE) or os.path.join(os.path.expanduser("~"), ".cache", "quillcount"))


def _session() -> SparkSession:
    return SparkSession.builder.appName("quillcount").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def count(o: argparse.Namespace, spark: SparkSession | None = None, stdin=None) -> str:
    """The report as text."""
    validate(o)
    if not registry.valid_model(o.model):
        print(f"Unknown model '{o.model}', using approximation methods", file=sys.stderr)
    is_directory = o.path != files.STDIN and os.path.isdir(o.path)
    if o.path != files.STDIN and not os.path.exists(o.path):
        raise FileNotFoundError(o.path)
    if is_directory and not o.recursive:
        raise UsageError("path is a directory; use --recursive to count tokens in all files")
    if o.cache and not is_directory:
        raise UsageError("--cache is only supported for recursive directory counts")
    if o.model.startswith(SENTENCEPIECE) and not o.vocab_file:
        raise UsageError(f"model {o.model} requires a SentencePiece vocab file; give it with --vocab-file")
    options = methods.Options(o.chars_per_token, o.words_per_token, o.vocab_file, o.provider)
    plan = methods.plan(o.model, o.all, options)
    spark = spark or _session()
    if is_directory:
        mode = inv.VERIFIED if o.cache_verify else inv.METADATA
        report, decisions = cached.count_directory(spark, o.path, plan, _store(spark) if o.cache else None, mode)
        row = report.first()
        if o.verbose:
            summary = inv.summary(decisions).first() if decisions is not None else {"hits": 0, "partial_hits": 0, "misses": 0, "incompatibilities": 0, "reasons": "none"}
            print(sinks.diagnostics(mode if o.cache else "disabled", row["file_count"], summary), file=sys.stderr)
    else:
        source = files.standard_input(spark, stdin) if o.path == files.STDIN else files.single_file(spark, o.path, reject_binary=False)
        rows = source.select("size", files.as_text(F.col("content")).alias("text"))
        row = counting.totals(counting.document_counts(rows, plan), plan, size="size").first()
    if o.json:
        return sinks.as_json(row, o.path, is_directory)
    return sinks.tokens_only(row) if o.tokens else sinks.as_table(row, o.path, is_directory, o.models)


def state_command(arguments: list[str]) -> str:
    p = argparse.ArgumentParser(prog="quillcount cache")
    sub = p.add_subparsers(dest="what", required=True)
    show = sub.add_parser("status")
    show.add_argument("path", nargs="?", default=".")
    show.add_argument("--json", action="store_true")
    clear = sub.add_parser("clear")
    clear.add_argument("path", nargs="?")
    clear.add_argument("--all", action="store_true")
    o = p.parse_args(arguments)
    store = _store(_session())
    if o.what == "status":
        s = store.status(o.path)
        return sinks.status_json(s) if o.json else f"Cache Status\n  Root: {s.root}\n  Present: {str(s.present).lower()}\n  Schema: {s.schema_version}\n  Entries: {s.entries}\n  Bytes: {s.bytes}\n  Generation: {s.generation}"
    if o.all and o.path:
        raise UsageError("--all cannot be combined with a cache path")
    if o.all:
        store.clear_all()
        return "Cleared all stored counts"
    store.clear(o.path or ".")
    return f"Cleared stored counts for {files.canonical_root(o.path or '.')}"


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    try:
        print(state_command(arguments[1:]) if arguments[:1] == ["cache"] else count(parser().parse_args(arguments)))
    except (ValueError, OSError, LookupError, state.StateError) as failure:
        print(failure, file=sys.stderr)
        return 1
    return 0
