"""Empty tables, nulls in every column, clashing names: nothing fails, and SQL agrees."""

import glob
import os

import duckdb
import pytest
from test_queries import plain

from airledger.plans import general, general_sql
from tables import copy

NAMES = list(general.QUERIES)


@pytest.fixture(scope="module")
def folders(tmp_path_factory, tiny):
    at = tmp_path_factory.mktemp("altered")
    return {kind: copy(tiny, str(at / kind), **{kind: True} if kind != "nulls" else {}) for kind in ("empty", "nulls", "ids")}


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, folders, name):
    assert general.QUERIES[name](spark, folders["empty"]).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_null_ids(spark, folders, name):
    assert general.QUERIES[name](spark, folders["ids"]).count() >= 0


@pytest.mark.parametrize("name", NAMES)
def test_nulls(spark, folders, name):
    con = duckdb.connect()
    for path in glob.glob(f"{folders['nulls']}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = general.QUERIES[name](spark, folders["nulls"])
    columns = sorted(df.columns)
    # a null source is a source of its own in the operators; the SQL leaves it out or not
    keep = lambda row: "sensor_id" not in columns or row[columns.index("sensor_id")] is not None
    got = sorted(filter(keep, (tuple(plain(r[c]) for c in columns) for r in df.collect())), key=repr)
    result = con.execute(general_sql.SQL[name])
    names = [x[0] for x in result.description]
    want = sorted(filter(keep, (tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())), key=repr)
    if name.startswith("p4"):
        known = {float(r[0]) for r in con.execute("select reading_id from hourly where sensor_id is not null").fetchall()}
        at = columns.index("reading_id")
        got, want = ([r for r in rows if r[at] in known] for rows in (got, want))
    assert got == want
