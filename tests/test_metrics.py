import threading
import time

import pytest

from quillcount.operators import counting, metrics, tokenizers
from quillcount.plans import methods

PLAN = methods.plan("", True, methods.Options(vocabularies={e: "/nowhere" for e in methods.REPORTED_BPE}))

# Texts and their counts under o200k and cl100k.
PINNED = [("Hello, world!", 4, 4), ("The quick brown fox jumps over the lazy dog.", 10, 10), ("\n", 1, 1)]


def test_observation_changes_nothing(spark):
    df = spark.createDataFrame([("abcd",), ("abcdefgh",)], "text string")
    counts, seen = metrics.observed(counting.document_counts(df, PLAN), PLAN)
    assert counts.collect() == counting.document_counts(df, PLAN).collect()
    got = seen.get
    assert (got["files"], got["bytes"], got["largest"], got["tokens_gemini_approx"]) == (2, 12, 8, 3)
    assert metrics.tokenizer_calls(got) == 4


def test_cancellation(spark):
    failed = []

    def work():
        with metrics.cancellable(spark, "slow"):
            try:
                spark.range(0, 10**12, 1, 4).selectExpr("sum(id * id % 7)").collect()
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(60):
        time.sleep(0.5)
        metrics.cancel(spark, "slow")
        if failed:
            break
    thread.join(30)
    assert failed


@pytest.mark.parametrize(("column", "encoding"), [(1, "o200k_base"), (2, "cl100k_base")])
def test_pinned_counts(spark, column, encoding):
    path = tokenizers.vocabulary_path(encoding)
    if path is None:
        pytest.skip(f"no rank table for {encoding}")
    df = spark.createDataFrame([(p[0],) for p in PINNED], "text string")
    assert [r[0] for r in df.select(tokenizers.bpe_count(encoding, path)("text")).collect()] == [p[column] for p in PINNED]
