import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcount.llm import mixing

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("targets", [None, {"en": 0.25, "de": 0.25, "fr": 0.45, "es": 0.05}, {"en": 1.0}])
def test_totals_meet_targets(spark, targets):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    domains = mixing.learn(docs, "lang")
    steps = mixing.fit(docs, domains, targets)
    texts = [r.text for r in docs.select("text").collect()]
    import pyarrow as pa

    n, p = domains.posteriors(pa.array(texts))
    assert n.tolist() == [len(t.split()) for t in texts] or abs(n.sum() / sum(len(t.split()) for t in texts) - 1) < 0.01
    r = mixing.rates(p, steps)
    want = np.array([1.0 if targets is None else targets.get(x, 0.0) for x in domains.names])
    got = (r * n) @ p
    assert (r >= 0).all()
    if targets != {"en": 1.0}:  # soft posteriors can't leave nothing of a domain
        assert np.abs(got / got.sum() - want / want.sum()).max() < 1e-6
    out = mixing.mixed(docs, domains, steps)
    assert out.columns == [*docs.columns, "mix_tokens", "mix_domain", "mix_share", "mix_rate"] and out.count() == docs.count()
    right = out.agg(F.avg((F.col("mix_domain") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97


def test_projection_against_brute_force():
    """Against plain projected gradient descent with a small step, on a problem where rates reach 0."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet((0.2, 0.2, 0.2), 400)
    n = rng.integers(1, 50, 400).astype(float)
    want = np.array([0.9, 0.08, 0.02]) * n.sum()
    steps = []
    for _ in range(mixing.STEPS):
        r = mixing.rates(p, steps)
        gram = (p * (n * (r > 0))[:, None]).T @ p
        steps.append(np.linalg.pinv(gram) @ ((r * n) @ p - want))
    r = np.ones(400)
    for _ in range(40_000):
        r = np.maximum(0, r - 1e-4 * p @ ((r * n) @ p - want) / n.mean() / 10)
    fast, slow = mixing.rates(p, steps), r
    assert (fast == 0).any() and np.abs((fast * n) @ p - want).sum() < 1e-6 * n.sum()
    assert np.abs((slow * n) @ p - want).sum() < 0.05 * n.sum()  # plain steps are still on their way


def test_edges(spark, edge_docs, no_docs):
    out = mixing.mix(edge_docs, "lang").collect()
    assert len(out) == edge_docs.count() and all(r.mix_rate >= 0 for r in out) and out[0].rep == "text0"
    none = mixing.mix(edge_docs.withColumn("lang", F.lit(None).cast("string")), "lang").collect()
    assert {r.mix_rate for r in none} == {1.0} and {r.mix_domain for r in none} == {None}
    assert mixing.mix(no_docs, "lang").collect() == []
    again = mixing.mix(mixing.mix(edge_docs, "lang"), "lang")
    assert len(again.columns) == len({*again.columns})
