import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillcount.llm import fingerprints as fp

DATA = "/root/testdata/sf0.001"


def weights(text):
    n = Counter(w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if w)
    return {w: 1 + math.log(c) for w, c in n.items()}


def alike(a, b):
    a, b = weights(a), weights(b)
    return sum(min(a.get(w, 0), b.get(w, 0)) for w in a | b) / sum(max(a.get(w, 0), b.get(w, 0)) for w in a | b)


def edited(rows):
    ids = sorted(rows, reverse=True)
    out = {}
    for i, d in enumerate(ids):
        t, u = rows[d] or "", rows[ids[(i + 1) % len(ids)]] or ""
        k = len(t) // 3
        out[d] = t[: len(t) - k] + u[:k]
    return out


def test_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in fp.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    other, by_text, errors = edited(rows), {}, []
    ids = sorted(rows, reverse=True)
    for i, d in enumerate(ids):
        x = got[d]
        assert x.n_chars == len(rows[d]) and x.edited_sha256 == hashlib.sha256(other[d].encode()).hexdigest()
        assert by_text.setdefault(rows[d], x.fingerprint) == x.fingerprint and len(x.fingerprint) == 6 * fp.SAMPLES
        nxt = got[ids[(i + 1) % len(ids)]].fingerprint
        assert abs(x.near_next - sum(x.fingerprint[j : j + 6] == nxt[j : j + 6] for j in range(0, len(nxt), 6)) / fp.SAMPLES) < 1e-9
        errors.append(x.near_edited - alike(rows[d], other[d]))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.3


def test_collision_rate(spark):
    """Over many unrelated pairs the share of equal samples is the generalised Jaccard similarity."""
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices([f"w{i // 2}x{j}" for j in range(60)], [1 / (j + 1) for j in range(60)], k=rnd.choice((40, 120))))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fp.fingerprinted(df, ["doc_id"], "text").collect()}
    real, seen = [], []
    for a in range(0, 600, 2):
        b = a + 1
        real.append(alike(rows[a][1], rows[b][1]))
        seen.append(sum(got[a][j : j + 6] == got[b][j : j + 6] for j in range(0, 6 * fp.SAMPLES, 6)) / fp.SAMPLES)
    assert abs(sum(real) / len(real) - sum(seen) / len(seen)) < 0.02


def test_edges(spark, edge_docs, no_docs):
    rows = {r.doc_id: r.text for r in edge_docs.collect()}
    got = {r.doc_id: r for r in fp.fingerprints(edge_docs).collect()}
    assert {d: r.edited_sha256 for d, r in got.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in edited(rows).items()}
    assert got[0].fingerprint == "" and got[0].near_edited == 1.0 and got[7].fingerprint == got[8].fingerprint
    assert fp.fingerprints(no_docs).collect() == []
    twice = edge_docs.unionByName(edge_docs)
    assert fp.fingerprints(twice).count() == 2 * len(rows)
    one = fp.fingerprints(edge_docs.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    # Rows without an id have a fingerprint and no neighbour.
    lost = fp.fingerprints(edge_docs.unionByName(edge_docs.filter("doc_id > 4").withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert sorted((r.n_chars, r.fingerprint) for r in lost if r.doc_id is None) == sorted((r.n_chars, r.fingerprint) for d, r in got.items() if d > 4)
    assert all(r.near_next is None and r.edited_sha256 is None for r in lost if r.doc_id is None)
    assert {r.doc_id: r for r in lost if r.doc_id is not None} == got
