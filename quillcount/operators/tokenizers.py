"""Byte-pair and SentencePiece tokenizers as Arrow UDFs.

A vocabulary is loaded once per Python worker, from a path that the workers reach. What can't be done by
Catalyst is the merge alone; pieces (functions.pieces) are there too, for cross-checks and frequencies.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pieces import PATTERNS, pieces

ENCODINGS = tuple(PATTERNS)
#: Folder of public vocabularies; the path of each can be given instead.
FOLDER = "/opt/tokenizers"
#: Files of that folder under other names: a table of 50,256 ranks with the r50k pattern and its ids.
FILES = {"r50k_base": "byte_bpe_50k.tiktoken"}

# Special tokens of the encodings.
_END, _PROMPT, _PREFIX, _MIDDLE, _SUFFIX = "<|endoftext|>", "<|endofprompt|>", "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>"
SPECIAL = {
    "o200k_base": {_END: 199999, _PROMPT: 200018},
    "cl100k_base": {_END: 100257, _PREFIX: 100258, _MIDDLE: 100259, _SUFFIX: 100260, _PROMPT: 100276},
    "p50k_base": {_END: 50256},
    "p50k_edit": {_END: 50256, _PREFIX: 50281, _MIDDLE: 50282, _SUFFIX: 50283},
    "r50k_base": {_END: 50256},
}


def vocabulary_path(encoding: str, given: dict[str, str] | None = None, folder: str = FOLDER) -> str | None:
    """Where an encoding's rank table is, or None."""
    path = (given or {}).get(encoding) or os.path.join(folder, FILES.get(encoding, f"{encoding}.tiktoken"))
    return path if os.path.exists(path) else None


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a table of lines "base64 rank"; blank lines and lines of another number of fields are skipped."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f.read().splitlines():
            fields = line.split()
            if len(fields) == 2:
                ranks[base64.b64decode(fields[0], validate=True)] = int(fields[1])
    return ranks


@functools.lru_cache(maxsize=8)
def encoder(encoding: str, path: str):
    """The tokenizer of an encoding; its pattern in the syntax of the tokenizer's own regular expressions."""
    import tiktoken

    return tiktoken.Encoding(encoding, pat_str=PATTERNS[encoding].replace(r"\x{85}", r"\x85"), mergeable_ranks=read_ranks(path), special_tokens=SPECIAL[encoding])


@functools.lru_cache(maxsize=8)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def bpe_count(encoding: str, path: str):
    """UDF: tokens of a text; special tokens' strings are ordinary text. Null for null."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(encoding, path)
        for texts in batches:
            given = texts.fillna("").tolist()
            yield pd.Series([len(x) for x in enc.encode_ordinary_batch(given, num_threads=1)], dtype="Int64").mask(texts.isna().to_numpy())

    return count


def bpe_encode(encoding: str, path: str, allowed: Collection[str] | str = (), disallowed: Collection[str] | str = ()):
    """UDF: token ids. allowed and disallowed special tokens, each a set or "all"; a disallowed one in a text is an error."""
    special = {*SPECIAL[encoding]}
    allow = special if allowed == "all" else {*allowed}
    forbid = special - allow if disallowed == "all" else {*disallowed}

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(encoding, path)
        for texts in batches:
            given = texts.fillna("").tolist()
            ids = enc.encode_batch(given, allowed_special=allow, disallowed_special=forbid, num_threads=1) if allow or forbid else enc.encode_ordinary_batch(given, num_threads=1)
            yield pd.Series([None if gone else x for x, gone in zip(ids, texts.isna(), strict=True)])

    return encode


def bpe_decode(encoding: str, path: str):
    """UDF: token ids to bytes; unknown ids are left out."""

    @F.pandas_udf(T.BinaryType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(encoding, path)
        table = {i: t for t, i in enc._mergeable_ranks.items()} | {i: t.encode() for t, i in SPECIAL[encoding].items()}
        for lists in batches:
            yield pd.Series([None if ids is None else b"".join(table.get(int(i), b"") for i in ids) for ids in lists])

    return decode


def spm_count(path: str):
    """UDF: tokens of a text under a SentencePiece model. Null for null."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = processor(path)
        for texts in batches:
            ids = model.encode(texts.fillna("").tolist(), num_threads=1)
            yield pd.Series([len(x) for x in ids], dtype="Int64").mask(texts.isna().to_numpy())

    return count


def vocabulary(spark, path: str) -> DataFrame:
    """token, rank of a rank table, as a frame."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where((F.size("p") == 2) & (F.get("p", F.lit(0)) != ""))
    return rows.select(F.unbase64(F.col("p")[0]).alias("token"), F.col("p")[1].cast("int").alias("rank"))


def piece_frequencies(df: DataFrame, text: str = "text", encoding: str = "r50k_base") -> DataFrame:
    """piece, n: how often each piece stands in all texts; counted before the shuffle."""
    return df.select(F.explode(pieces(F.col(text), encoding)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def relational_counts(df: DataFrame, key: str, path: str, text: str = "text", encoding: str = "r50k_base") -> DataFrame:
    """key, tokens by way of distinct pieces: whole-piece ranks by join, merges only for pieces without one.

    A cross-check of bpe_count(), and of use where few distinct pieces make up very many texts.
    """
    rows = df.select(key, F.explode_outer(pieces(F.coalesce(F.col(text), F.lit("")), encoding)).alias("piece"))
    counted = rows.where("piece is not null").groupBy("piece").agg(F.count("*").alias("n")).select("piece")
    ranks = vocabulary(df.sparkSession, path).select(F.col("token").alias("b"), F.lit(1).cast("long").alias("whole"))
    known = counted.join(ranks, F.col("piece").cast("binary") == F.col("b"), "left").select("piece", "whole")
    split = bpe_count(encoding, path)
    known = known.where("whole is not null").unionByName(known.where("whole is null").select("piece", split("piece").alias("whole")))
    per = rows.groupBy(key, "piece").agg(F.count("*").alias("n")).join(known, "piece", "left")
    return per.groupBy(key).agg(F.sum(F.col("n") * F.coalesce("whole", F.lit(0))).alias("tokens"))
