"""The operators' queries against their SQL in DuckDB."""

import duckdb
import pytest

from quillcount.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(want.fetchall())


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{n}" for n in range(1, 11)]
