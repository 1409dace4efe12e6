"""Text statistics as Catalyst expressions: bytes, words, lines, ratio approximations, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a word are Unicode punctuation, separators and control white space.
WORD = r"[^\p{P}\p{Z}\t-\r\x{85}]+"
#: Characters for each token of the two built-in approximations, and the default ratios of the derived ones.
CLAUDE_RATIO, GEMINI_RATIO = 3.8, 4.0
CHARS_PER_TOKEN, WORDS_PER_TOKEN = 4.0, 0.75


def characters(text: Column) -> Column:
    """Length in UTF-8 bytes."""
    return F.octet_length(text).cast("long")


def words(text: Column) -> Column:
    """Maximal runs of characters that don't end a word; symbols such as + or $ are part of words."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def lines(text: Column) -> Column:
    r"""Line feeds, and one more for a last line without one; an empty text has none and \r alone ends no line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def truncated(amount: Column, ratio: float) -> Column:
    """amount / ratio, truncated toward 0."""
    if not ratio > 0:
        raise ValueError("a ratio has to be positive")
    return (amount / F.lit(float(ratio))).cast("long")


def claude_tokens(text: Column) -> Column:
    return truncated(characters(text), CLAUDE_RATIO)


def gemini_tokens(text: Column) -> Column:
    return truncated(characters(text), GEMINI_RATIO)


def digest(content: Column) -> Column:
    """SHA-256 of the bytes, lower-case hex."""
    return F.sha2(content, 256)


def with_stats(df, text: str = "text"):
    """df with the columns characters, words and lines of a text column; null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"characters": characters(t), "words": words(t), "lines": lines(t)})
