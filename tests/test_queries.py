"""Every registered query against its SQL in DuckDB."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from airledger.plans import all_queries, all_sql


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v) + 0.0
    return v if v is None or isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_like_sql(spark, tiny, duck, name):
    df = all_queries()[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(all_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs(spark, tiny, name):
    df = all_queries()[name](spark, tiny)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
