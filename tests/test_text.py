import pytest
from pyspark.sql import functions as F

from quillcount.functions import labels, pieces
from quillcount.functions import text as T

CASES = {
    "": (0, 0, 0),
    "The quick brown fox jumps over the lazy dog.": (44, 9, 1),
    "\r": (1, 0, 1),
    "   ": (3, 0, 1),
    "a\nb\n": (4, 2, 2),
    "a\nb": (3, 2, 2),
    "a+b$c": (5, 1, 1),
    "a-b_c": (5, 3, 1),
    "a\xa0b\x85c\u2028d\u3000e": (15, 5, 1),
    "a​b": (5, 1, 1),
    "né 🙂": (8, 2, 1),
    "x\x0by": (3, 2, 1),
}


def test_statistics(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "text string")
    got = {r.text: (r.characters, r.words, r.lines) for r in T.with_stats(df).collect()}
    assert got == CASES
    assert T.with_stats(spark.createDataFrame([(None,)], "text string")).first().characters == 0


def test_invalid_utf8_keeps_its_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xff\xfeb c"),)], "content binary").select(F.col("content").cast("string").alias("text"))
    assert T.with_stats(df).first().characters == 6


def test_ratios(spark):
    df = spark.createDataFrame([("x" * 44,)], "text string")
    assert df.select(T.claude_tokens(F.col("text")), T.gemini_tokens(F.col("text"))).first() == (11, 11)
    for bad in (0, -1, float("nan")):
        with pytest.raises(ValueError):
            T.truncated(F.lit(1), bad)


@pytest.mark.parametrize(
    ("tokens", "window", "said"),
    [(1, 0, ""), (1, None, ""), (25, 200, "12% of 200"), (15, 1000, "1.5% of 1K"), (2, 1000, "0.20% of 1K"), (1, 128000, "<0.1% of 128K"), (500000, 1047576, "48% of 1.0M"), (1, 10, "10% of 10"), (700000, 1000000, "70% of 1M"), (150000, 1500000, "10% of 1.5M")],
)
def test_context_usage(tokens, window, said):
    assert labels.context_usage(tokens, window) == said


def test_labels(spark):
    assert labels.thousands(-1234567) == "-1,234,567"
    assert [labels.encoding_of(m) for m in ("GPT-4o", "gpt-4-turbo", "text-davinci-003", "other")] == [("o200k_base", True), ("cl100k_base", True), ("p50k_base", True), ("o200k_base", False)]
    df = spark.createDataFrame([("-", False, "abcdefghij"), ("d", True, "abc")], "path string, dir boolean, long string")
    assert [tuple(r) for r in df.select(labels.display_path(F.col("path"), F.col("dir")), labels.shortened(F.col("long"), 5)).collect()] == [("stdin", "ab…ij"), ("d (directory)", "abc")]
    rows = spark.createDataFrame([("a", True), ("claude_3_approx", False), ("b", False)], "n string, e boolean")
    assert [r[0] for r in rows.select(labels.accuracy(F.col("n"), F.col("e"))).collect()] == ["Exact", "Estimated", "Approx"]


def test_pieces_of_the_encodings(spark):
    import regex

    texts = ["HelloWorld camelCase CamelCASE", "I'LL don't we'Ve", "1234567 12", "a  b\n\n c \t\n", "x　　y\u0085z", "ǅungla ſ's", "\r\n\v", "", "été //x/\n/", "...!!!\n\n  "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for name, pattern in pieces.PATTERNS.items():
        want = [regex.findall(pattern.replace(r"\x{85}", r"\x85"), t) for t in texts]
        assert [r[0] for r in df.select(pieces.pieces(F.col("text"), name)).collect()] == want, name
    n = [df.select(F.sum(pieces.piece_count(F.col("text"), e))).first()[0] for e in ("cl100k_base", "o200k_base")]
    assert n[0] != n[1]
