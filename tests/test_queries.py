"""Every registered pattern query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from bimosaic.plans import queries as plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def rows(found, columns):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(value(r[c]) for c in columns) for r in found)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.Q))
def test_query(spark, duck, name):
    df = plans.Q[name](spark, DIR)
    got = [r.asDict() for r in df.collect()]
    if name not in plans.SQL:
        assert got
        return
    out = duck.sql(plans.SQL[name])
    assert sorted(out.columns) == sorted(df.columns)
    expected = [dict(zip(out.columns, r)) for r in out.fetchall()]
    assert rows(got, sorted(df.columns)) == rows(expected, sorted(df.columns))
