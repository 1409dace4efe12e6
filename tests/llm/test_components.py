import random

from quillcount.llm.components import components


def brute(edges):
    part = {}

    def root(v):
        while part.setdefault(v, v) != v:
            v = part[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        part[y] = x
    return {v: root(v) for v in part if root(v) != v}


def test_chains_stars_and_random_graphs(spark):
    rnd = random.Random(8)
    chain = list(range(100, 160))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(500, i) for i in range(501, 540)] + [(7, 7), (2, 1), (1, 2)]
    edges += [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.v: r.p for r in components(df).collect()} == brute([e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
