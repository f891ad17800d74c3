from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from airledger.llm import queries
from airledger.llm.splits import assign_components, present_table, split_name, station_number

SHARES = {"train": 0.65, "test": 0.2, "cal": 0.15}


def test_writings(spark):
    texts = ["19001", "#19001", "ST-19001", " 19001 ", "st_19001", "19001.0", "St. 19001", "１９００１", "019001"]
    rows = [(t,) for t in texts] + [(None,), ("",), ("none",), ("1 and 2",), ("9" * 40,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(station_number(F.col("t"))).collect()]
    assert got == [19001] * len(texts) + [None] * 5
    names = [(" Train ",), ("TEST",), ("cal\t",), ("valid",), (None,), ("",)]
    assert [r[0] for r in spark.createDataFrame(names, "t string").select(split_name(F.col("t"))).collect()] == ["train", "test", "cal", None, None, None]


def test_new_components_meet_the_shares(spark):
    rows = [(f"m{i}", 1 + i % 3) for i in range(3000)] + [("huge", 2000), (None, 5)]
    done = assign_components(spark.createDataFrame(rows, "member string, n long"), SHARES).members.collect()
    n = dict(rows[:-1])
    assert Counter(r["member"] for r in done) == Counter(n.keys())
    held = Counter()
    for r in done:
        assert r["status"] == "new"
        held[r["split"]] += n[r["member"]]
    total = sum(n.values())
    for s, share in SHARES.items():
        assert abs(held[s] / total - share) < 0.005


def test_kept_linked_and_quarantined(spark):
    table = spark.createDataFrame([("a", "c1", "train"), ("b", "c2", "test"), ("c", "c2", "test"), ("d", "c3", "cal"), ("z", "c9", "train")], "member string, component string, split string")
    sizes = spark.createDataFrame([("a", 4), ("b", 1), ("d", 2), ("e", 3), ("f", 1), ("g", 5)], "member string, n long")
    links = spark.createDataFrame([("a", "e"), ("b", "d"), ("f", "g"), ("g", "f"), ("a", None), ("a", "a")], "a string, b string")
    done = {r["member"]: r for r in assign_components(sizes, SHARES, links, table).members.collect()}
    assert (done["a"]["split"], done["a"]["status"]) == ("train", "kept") == (done["e"]["split"], done["e"]["status"])
    assert {done[m]["status"] for m in "bcd"} == {"quarantined"} and done["b"]["split"] is None
    assert done["f"]["status"] == "new" and done["f"]["component"] == done["g"]["component"] and done["f"]["split"] == done["g"]["split"]
    assert done["z"]["split"] == "train"
    again = assign_components(spark.createDataFrame([("e", 1), ("h", 1)], "member string, n long"), SHARES, table=spark.createDataFrame([tuple(r) for r in done.values()], "member string, component string, split string, status string")).members.collect()
    again = {r["member"]: r for r in again}
    assert (again["e"]["split"], again["e"]["component"]) == ("train", done["e"]["component"])
    assert {again[m]["status"] for m in "bcd"} == {"quarantined"} and again["h"]["status"] == "new"


def test_empty(spark):
    none = spark.createDataFrame([], "member string, n long")
    assert assign_components(none, SHARES).members.collect() == []
    assert assign_components(none, SHARES, table=spark.createDataFrame([], "member string, component string, split string")).members.collect() == []


def test_present_table_leaves_out_unknown(spark):
    rows = [(1, "train"), (1, "train"), (1, "cal"), (None, "cal"), (2, None), (3, "test")]
    got = present_table(spark.createDataFrame(rows, "station_no long, split string")).collect()
    assert sorted((r["member"], r["split"]) for r in got) == [("1", "cal"), ("1", "train"), ("3", "test")]


@pytest.mark.parametrize("scale", ["tiny", "small"])
def test_queries(spark, request, scale):
    d = request.getfixturevalue(scale)
    stations = defaultdict(set)
    sp = spark.read.parquet(f"{d}/sp.parquet").select("_row", station_number(F.col("station_id")).alias("no"), split_name(F.col("split")).alias("split")).collect()
    for r in sp:
        if r["no"] is not None and r["split"]:
            stations[r["no"]].add(r["split"])
    assert {r[0] for r in queries.p3_found(spark, d).collect()} == {k for k, v in stations.items() if len(v) > 1}
    out = queries.p3_splits(spark, d).collect()
    assert Counter(r["_row"] for r in out) == Counter(r["_row"] for r in sp)
    homes = defaultdict(set)
    for r in out:
        homes[r["station_no"] if r["station_no"] is not None else f"row {r['_row']}"].add(r["split"])
    assert all(len(v) == 1 for v in homes.values())
    for s, share in SHARES.items():
        assert abs(sum(r["split"] == s for r in out) / len(out) - share) < 0.02
