"""Empty tables, nulls in every column, clashing names: nothing fails, and SQL agrees."""

import glob
import os

import duckdb
import pytest
from tables import copy
from test_queries import plain

from airledger.llm import queries

NAMES = list(queries.QUERIES)


@pytest.fixture(scope="module")
def folders(tmp_path_factory, tiny):
    at = tmp_path_factory.mktemp("altered")
    return {kind: copy(tiny, str(at / kind), **{kind: True} if kind != "nulls" else {}) for kind in ("empty", "nulls", "ids")}


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, folders, name):
    assert queries.QUERIES[name](spark, folders["empty"]).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_null_ids(spark, folders, name):
    assert queries.QUERIES[name](spark, folders["ids"]).count() >= 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_nulls(spark, folders, name):
    con = duckdb.connect()
    for path in glob.glob(f"{folders['nulls']}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = queries.QUERIES[name](spark, folders["nulls"])
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(queries.SQL[name])
    names = [x[0] for x in result.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want
