import hashlib
import random

import pytest

from quillcount.llm import repeats

DATA = "/root/testdata/sf0.001"


def brute(rows):
    """rows: (doc_id, text) in order; the result for each."""
    seen, out = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def passages():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdé", k=rnd.randrange(1, 7)))
    shared = [" ".join(word() for _ in range(n)) for n in (12, 20, 25, 60, 200)]
    rows = []
    for i in range(90):
        parts = [" ".join(word() for _ in range(rnd.randrange(0, 60)))]
        for _ in range(rnd.randrange(0, 3)):
            parts += [rnd.choice(shared)[rnd.randrange(0, 30) :], " ".join(word() for _ in range(rnd.randrange(0, 20)))]
        if i % 9 == 0:
            parts.append("ab" * rnd.randrange(40, 200))
        if i % 10 == 0:
            parts.append("=" * rnd.randrange(90, 300))
        rows.append((i * 7, "".join(parts)))
    return rows


def test_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
    assert sum(x[1] for x in want.values()) > 1000
    assert of(repeats.remove_repeats(docs)) == want


@pytest.mark.parametrize(("dealt", "hot"), [(256, 20_000), (256, 3), (2, 3)])
def test_passages(spark, dealt, hot):
    """Also with limits so low that hot grams are dealt and their windows shuffled."""
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert of(repeats.remove_repeats(docs, dealt, hot)) == brute(rows)


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.orderBy("doc_id").collect()]
    short = [(d, t if t is None or len(t) < 40_000 else t[:4000]) for d, t in rows]
    docs = spark.createDataFrame(short, "doc_id long, text string")
    assert of(repeats.remove_repeats(docs)) == brute(short)
    assert of(repeats.remove_repeats(docs.unionByName(docs))) == brute(short)
    assert repeats.remove_repeats(docs.unionByName(docs)).count() == 2 * len(short)
    assert repeats.remove_repeats(no_docs).collect() == []
    whole = of(repeats.remove_repeats(edge_docs))
    assert whole[9][1] == 200_000 - 1 and whole[9][2] == 1
