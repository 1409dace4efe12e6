"""Pre-tokenisation of byte-pair encodings as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\t-\r\x{85}\p{Z}]"
_NOT_SPACE = r"[^\t-\r\x{85}\p{Z}]"

# The encodings' public patterns, \s and \S spelled out.
PATTERNS = {
    "r50k_base": rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\t-\r\x{{85}}\p{{Z}}\p{{L}}\p{{N}}]+|{_SPACE}+(?!{_NOT_SPACE})|{_SPACE}+",
    "cl100k_base": rf"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{{L}}\p{{N}}]?\p{{L}}+|\p{{N}}{{1,3}}| ?[^\t-\r\x{{85}}\p{{Z}}\p{{L}}\p{{N}}]+[\r\n]*|{_SPACE}*[\r\n]+|{_SPACE}+(?!{_NOT_SPACE})|{_SPACE}+",
    "o200k_base": r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    rf"|\p{{N}}{{1,3}}| ?[^\t-\r\x{{85}}\p{{Z}}\p{{L}}\p{{N}}]+[\r\n/]*|{_SPACE}*[\r\n]+|{_SPACE}+(?!{_NOT_SPACE})|{_SPACE}+",
}
PATTERNS["p50k_base"] = PATTERNS["p50k_edit"] = PATTERNS["r50k_base"]


def pieces(text: Column, encoding: str = "r50k_base") -> Column:
    """Array of a text's pieces, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERNS[encoding]), F.lit(0))


def piece_count(text: Column, encoding: str = "r50k_base") -> Column:
    return F.size(pieces(text, encoding)).cast("long")
