"""Every query of the catalogue against its SQL in DuckDB, values and column names."""

import datetime
import decimal
import math

import duckdb
import pytest

from quillcount import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations", "labels")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral() else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, DATA)
    want = duck.execute(core.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda data, cols: sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in data), key=repr)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), names)
