"""Toxicity and language models: held-out accuracy, neutrality of identity terms, odd tables."""

from pyspark.sql import functions as F

from quillcount.llm import language, toxicity

DATA = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = toxicity.toxicity(docs, labels)
    assert out.count() == docs.count()
    held = out.join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in held}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.8 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.9


def test_counterfactual_penalty(spark):
    """The term men stands in toxic texts more often; the penalty keeps its weight and that of women together."""
    rows = [(i, ("vile rubbish " if i % 2 else "nice weather ") + ("men" if (i % 2) ^ (i % 7 == 0) else "women") + f" here {i}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    probe = spark.createDataFrame([(0, "men"), (1, "women"), (2, "vile rubbish men"), (3, "vile rubbish women"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scores(probe, model).collect()}
    assert abs(got[0] - got[1]) < 0.1 and min(got[2], got[3]) > 0.8 and got[4] == got[5]


def test_toxicity_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (4, 0, 0), (None, 1, 1), (5, 1, None), (6, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some, some.filter("toxic = 1")):
        out = toxicity.toxicity(edge_docs, labels).collect()
        assert len(out) == edge_docs.count() and all(0 <= r.score <= 1 for r in out)
        assert toxicity.reject_toxic(edge_docs, labels).columns == edge_docs.columns
    assert toxicity.toxicity(no_docs, some).collect() == []


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id")
    r = out.filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert r.right > 0.98 and r.n > 2000


def test_filters_hold_every_language_of_a_gram():
    import numpy as np

    f = language.Filters.build({"a": np.arange(1000, dtype=np.uint64), "b": np.arange(500, 1500, dtype=np.uint64)})
    got = f.count(np.zeros(1500, np.int64), np.arange(1500, dtype=np.uint64), 1)[0]
    assert (abs(got - 1000) <= 3).all() and f.languages == ["a", "b"]


def test_language_edges(edge_docs, no_docs):
    out = {r.doc_id: r for r in language.language_id(edge_docs).collect()}
    assert len(out) == edge_docs.count()
    assert {out[i].lang_pred for i in (0, 1, 2, 3, 10, 13)} == {"und"} and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in language.language_id(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.language_id(no_docs).collect() == []


def _neutral_gap(spark, model):
    """The largest difference of scores between mentions of groups and of nobody in particular, in two languages."""
    frames = [("today {} came to the market and bought bread", "people women men muslims jews christians refugees".split()), ("heute kamen {} auf den markt und kauften brot", "menschen frauen juden muslime türken".split())]
    rows = [(i * 100 + j, t.format(w)) for i, (t, words) in enumerate(frames) for j, w in enumerate(words)]
    got = {r.doc_id: r.score for r in toxicity.scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    return max(abs(s - got[d // 100 * 100]) for d, s in got.items())


def test_penalty_is_active(spark):
    """No text of the tables names a group; planted terms make the penalty act, and it narrows the gap of biased labels."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = toxicity._sample(docs, labels)
    problem = toxicity.problem_of(rows, toxicity.TERM_FEATURES)
    assert len(problem.weights) > 100 and abs(problem.weights.sum() - 1) < 1e-9 and len({*problem.swap_cols.tolist()}) > 300
    # Toxic texts name groups more often than others do: the bias that a corpus brings along.
    terms = "muslims jews refugees muslime juden women".split()
    biased = [(i, ("you vile rotten idiot " if i % 2 else "what a sunny calm morning ") + (terms[i % 6] if i % 2 or i % 5 == 0 else "people") + f" number {i % 9}") for i in range(1200)]
    more = spark.createDataFrame(biased, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(1200)], "doc_id long, toxic int")
    with_penalty, without = (_neutral_gap(spark, toxicity.train(more, known, p)) for p in (toxicity.SWAP_PENALTY, 0.0))
    assert with_penalty < 0.5 * without and with_penalty < 0.15


def test_gradient(spark):
    """The gradient against differences of the loss, at random weights."""
    import numpy as np

    rows = spark.createDataFrame([("bad women here", 1), ("nice men there", 0), ("les femmes et les musulmans", 0), ("nothing at all", 1), ("", 0)], "text string, label long")
    vocabulary = np.unique(np.concatenate([toxicity.TERM_FEATURES, *toxicity.features(__import__("pyarrow").array(["bad nice here there nothing"]))]))
    problem = toxicity.problem_of(rows, vocabulary, 3.0)
    w = np.random.default_rng(4).normal(size=len(vocabulary) + 1)
    g, step = problem.gradient(w), 1e-5
    used = np.unique(np.concatenate([problem.cols, problem.swap_cols, [len(vocabulary)]]))
    for i in used[:: max(1, len(used) // 60)].tolist() + [len(vocabulary)]:
        e = np.zeros(len(w))
        e[i] = step
        assert abs((problem.loss(w + e) - problem.loss(w - e)) / (2 * step) - g[i]) < 1e-6


def test_swaps_change_the_word_sequence():
    """Features that other words carry stay; every other term of the group is tried."""
    import pyarrow as pa

    for text in ("the women were wonderful", "Juden und Judentum", "nothing to swap in this sentence", "gay men and gay women"):
        pairs = list(toxicity.swaps(text))
        assert pairs
        if "women were" in text:
            by_hand = [next(toxicity.features(pa.array([text.replace("women", w)]))) for w in toxicity.IDENTITY_TERMS[0] if w != "women"]
            mine = next(toxicity.features(pa.array([text])))
            for (gone, new), other in zip(pairs, by_hand, strict=True):
                assert {toxicity.KEY_HASHES[k] for k in gone} == {*mine.tolist()} - {*other.tolist()}
                assert {toxicity.KEY_HASHES[k] for k in new} == {*other.tolist()} - {*mine.tolist()}
    assert list(toxicity.swaps("")) == [] == list(toxicity.swaps("... !"))
