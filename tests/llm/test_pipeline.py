"""Each stage on its own input, against brute force."""

import pytest
from pyspark.sql import functions as F

from . import test_decontaminate, test_near_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from quillcount.llm import secrets, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "near_dedup", "decontamination", "secrets", "mixing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = stages["toxicity"](spark, docs, DATA).cache()
    assert ids(out) == ids(toxicity.toxicity(docs, labels).filter("predicted = 0")) and out.columns == docs.columns
    wrong = labels.filter("toxic = 0").join(docs, "doc_id").select("doc_id").exceptAll(out.select("doc_id")).count()
    assert wrong == 0 and labels.filter("toxic = 1").join(out, "doc_id").count() <= 3  # of 11, learned from a few rows

    before = out
    out = stages["near_dedup"](spark, before, DATA).cache()
    groups = test_near_dedup.brute(texts(before), 5, 80)
    assert ids(out) == {d for d, (_, c) in groups.items() if c == d} and out.columns == docs.columns

    before = out
    out = stages["decontamination"](spark, before, DATA).cache()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    hit = {d for d, _ in test_decontaminate.brute(texts(before), [(r.item_id, r.text) for r in items.collect()])}
    assert ids(out) == ids(before) - hit and out.columns == docs.columns

    before = out
    out = stages["secrets"](spark, before, DATA).cache()
    make = secrets._compressor()
    assert dict(texts(out)) == {d: secrets.redact(t, make) for d, t in texts(before)}
    assert out.filter(F.length("text") != F.col("n_chars")).count() == 0 and out.columns == docs.columns

    last = stages["mixing"](spark, out, DATA)
    assert ids(last) == ids(out)
    assert corpus_pipeline.run(spark, DATA).count() == out.count()


def test_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
        assert "mix_rate" in docs.columns and docs.filter("mix_rate is null").count() == 0
