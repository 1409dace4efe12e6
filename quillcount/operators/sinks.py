"""Sinks of a report: JSON, a bare number, a table, diagnostics."""

from __future__ import annotations

import json

from pyspark.sql import Row

from ..functions import labels
from ..plans import registry


def as_dict(report: Row, path: str, is_directory: bool) -> dict:
    """A report's public form; is_directory, file_count and context_window are left out where zero."""
    out: dict = {"file_path": path}
    if is_directory:
        out |= {"is_directory": True, "file_count": report["file_count"]}
    out |= {k: report[k] for k in ("file_size", "characters", "words", "lines")}
    out["methods"] = [{k: m[k] for k in ("name", "display_name", "tokens", "is_exact")} | ({"context_window": m["context_window"]} if m["context_window"] else {}) for m in report["methods"]]
    return out


def as_json(report: Row, path: str, is_directory: bool) -> str:
    return json.dumps(as_dict(report, path, is_directory), indent=2, ensure_ascii=False)


def tokens_only(report: Row) -> str:
    """Tokens of the first exact method, else of the first."""
    methods = sorted(report["methods"], key=lambda m: (not m["is_exact"], m["ord"]))
    if not methods:
        raise ValueError("no counting method")
    return str(methods[0]["tokens"])


def _accuracy(m) -> str:
    return "Exact" if m["is_exact"] else "Estimated" if m["name"] == "claude_3_approx" else "Approx"


def as_table(report: Row, path: str, is_directory: bool, show_models: bool = False) -> str:
    name = "stdin" if path == "-" else f"{path} (directory)" if is_directory else path
    stats = [("Files", report["file_count"])] if is_directory else []
    stats += [(k.capitalize(), report[k]) for k in ("characters", "words", "lines")]
    out = [f"Token Count Report for: {name}", "", "Basic Statistics", *(f"  {k}: {labels.thousands(v)}" for k, v in stats), "", "Token Counts by Method"]
    context = any(m["context_window"] for m in report["methods"])
    rows = [["Method", "Tokens", "Accuracy"] + ["Context Usage"] * context]
    rows += [[m["display_name"], labels.thousands(m["tokens"]), _accuracy(m)] + [labels.context_usage(m["tokens"], m["context_window"])] * context for m in report["methods"]]
    wide = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    line = lambda a, b, c: a + b.join("─" * (w + 2) for w in wide) + c
    cells = lambda r, head: "│" + "│".join(f" {x.center(w) if head else x.rjust(w) if i == 1 else x.ljust(w)} " for i, (x, w) in enumerate(zip(r, wide, strict=True))) + "│"
    out += [line("╭", "┬", "╮"), cells(rows[0], True), line("├", "┼", "┤"), *(cells(r, False) for r in rows[1:]), line("╰", "┴", "╯")]
    if show_models:
        out += ["", "Model Lookup", *(f"  {e}: {', '.join(sorted(m[0] for m in registry.MODELS if m[2] == e))}" for e in registry.ENCODINGS)]
    return "\n".join(out)


def diagnostics(mode: str, files: int, summary: Row) -> str:
    """One line on a recount's reuse."""
    return f"Cache diagnostics: mode={mode} files={files} hits={summary['hits']} partial_hits={summary['partial_hits']} misses={summary['misses']} incompatibilities={summary['incompatibilities']} reasons={summary['reasons']}"


def status_json(status) -> str:
    out = {"root": status.root, "present": status.present, "schema_version": status.schema_version, "entries": status.entries, "bytes": status.bytes, "generation": status.generation}
    if status.modified_at is not None:
        out["modified_at"] = status.modified_at
    return json.dumps(out)
