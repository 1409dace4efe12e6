import random
import re
from itertools import combinations

import pytest

from quillcount.llm.near_dedup import drop_near_duplicates, near_duplicates

DATA = "/root/testdata/sf0.001"


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            part[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def of(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("width", [4, 5])
def test_table(spark, width):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert of(near_duplicates(docs, width)) == brute([(r.doc_id, r.text) for r in docs.collect()], width, 80)


def test_chains_and_hubs(spark):
    """Chains whose ends differ, and a hub whose members are far from each other."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    rows = []
    for _ in range(6):
        text = [word() for _ in range(120)]
        for _ in range(12):
            rows.append((len(rows), " ".join(text)))
            at = rnd.randrange(len(text))
            text = [*text[:at], word(), *text[at + 1 :]]
        hub = [word() for _ in range(100)]
        for _ in range(15):
            at = rnd.randrange(0, 95)
            rows.append((len(rows), " ".join([*hub[:at], word(), word(), *hub[at + 2 :]]).upper()))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert of(near_duplicates(docs, 5)) == brute(rows, 5, 80)


def test_edges(edge_docs, no_docs):
    out = {r.doc_id: r for r in near_duplicates(edge_docs, 4).collect()}
    assert len(out) == edge_docs.count()
    assert out[0].n_shingles == 0 and out[0].kept and out[1].component_id == 1
    assert out[8].component_id == 7 and not out[8].kept and out[7].n_shingles == 3
    assert near_duplicates(no_docs, 4).collect() == []


def rows_left(rows, width, percent):
    """Brute force on rows: the rows that stay, as sorted (doc_id, text)."""
    keyed = [(i, t) for i, (_, t) in enumerate(rows)]
    groups = {}
    for i, (_, c) in brute(keyed, width, percent).items():
        groups.setdefault(c, set()).add(rows[i])
    picked = []
    for group in groups.values():
        low = min(d for d, _ in group)
        picked.append([r for r in group if r[0] == low])
    return picked


def test_repeated_ids(spark):
    """Rows are linked, not doc_ids: a doc_id with two texts joins nothing that its texts don't."""
    rnd = random.Random(12)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(n))
    w, u, t = text(40), text(40), text(40)
    rows = [(1, w), (5, w), (5, u), (7, u + " word"), (9, t), (9, t)]
    docs = spark.createDataFrame([(*r, f"x{i}") for i, r in enumerate(rows)], "doc_id long, text string, extra string")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, w), (5, u), (9, t)])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (9, 9, True), (9, 9, True)]

    base = [text(30) for _ in range(8)]
    rows = []
    for _ in range(150):
        words = rnd.choice(base).split()
        if rnd.random() < 0.6:
            words[rnd.randrange(30)] = rnd.choice("pqr")
        rows.append((rnd.randrange(25), " ".join(words)))
    got = sorted((r.doc_id, r.text) for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = rows_left(rows, 5, 80)
    assert len(got) == len(want) and all(sum(r in group for r in got) == 1 for group in want)


def test_rows_without_id_or_text_stay(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, None), (4, ""), (6, "a b c d e f"), (6, "a b c d e f")]
    out = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, rows[:-1]))


def test_members_of_a_hub(spark):
    """Clusters inside one large document, and a common line: links that don't go through the hub."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    parts = [[word() for _ in range(60)] for _ in range(6)]
    line = [word() for _ in range(25)]
    rows = [(0, " ".join(x for p in parts for x in p))]
    for p in parts:
        for _ in range(6):
            at = rnd.randrange(55)
            rows.append((len(rows), " ".join([*p[:at], word(), *p[at + 1 :]])))
    for _ in range(30):
        own = [word() for _ in range(rnd.choice((3, 8, 40)))]
        rows.append((len(rows), " ".join([*line, *own])))
        rows.append((len(rows), " ".join([*line, *own[:-1], word()])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert of(near_duplicates(docs, 5)) == brute(rows, 5, 80)
