import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from airledger.llm.percentiles import SUMMARY, Summary, _from_values, buffer_size, combine, percentiles, summarise

Q = np.array([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])


def within(values, got, err):
    values = np.sort(values)
    for q, x in zip(Q, got):
        rank = max(1, int(np.ceil(q * len(values) - 1e-9)))
        low, high = np.searchsorted(values, x, "left") + 1, np.searchsorted(values, x, "right")
        assert low - err <= rank <= high + err, (q, x, low, high, rank, err)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4000), st.sampled_from([8, 32, 100]), st.integers(1, 9), st.integers(1, 500))
def test_bound_holds_for_any_merging(seed, n, k, parts, distinct):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, distinct, n).astype(float) if distinct > 3 else rng.normal(size=n)
    whole = Summary(k)
    for part in np.array_split(values, parts):
        s = Summary(k)
        for piece in np.array_split(part, 3):
            s.add(np.sort(piece))
        whole.merge(*s.row())
    assert whole.n == n
    assert sum(len(b) << x for x, b in whole.levels.items()) + whole.tail_size == n
    within(values, whole.quantiles(Q), whole.err)
    assert whole.err <= n * max(1.0, np.log2(max(2, n / k))) / (2 * k) + 1
    if n < k:
        assert whole.err == 0


def test_table_and_days_combine(spark):
    rng = np.random.default_rng(5)
    rows = [("a" if rng.random() < 0.4 else None if rng.random() < 0.2 else "b", int(rng.integers(0, 4)), float(rng.normal() * 50), 1) for _ in range(6000)]
    rows += [("a", 1, None, 1), ("b", 2, float("nan"), 1), ("only", 3, float("nan"), 1)]
    df = spark.createDataFrame(rows, "place string, day int, value double, n int").repartition(7)
    days = summarise(df, ["place", "day"], "value", k=64)
    names = {f"q{i}": float(q) for i, q in enumerate(Q)}
    for keys, summaries in ((["place", "day"], days), (["place"], combine(days, ["place"], k=64))):
        got = percentiles(summaries, keys, names, k=64).collect()
        groups = {}
        for place, day, x, _ in rows:
            if x is not None and not np.isnan(x):
                groups.setdefault((place, day)[: len(keys)], []).append(x)
        assert {tuple(r[k] for k in keys) for r in got} == set(groups)
        for r in got:
            values = np.array(groups[tuple(r[k] for k in keys)])
            assert r["n"] == len(values) and r["rank_error"] <= 0.1 * r["n"]
            within(values, [r[n] for n in names], r["rank_error"])
    assert summarise(df.limit(0), ["place"], "value").collect() == []


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (10, 20, 30, 40, 100)], "g string, x double")
    row = percentiles(summarise(df, ["g"], "x"), ["g"], {"p50": 0.5}).first()
    assert (row["n"], row["p50"], row["rank_error"]) == (5, 30.0, 0)


@pytest.mark.parametrize("values", [[], [5.0]])
def test_tiny_summaries(values):
    s = Summary(4)
    s.add(np.array(values))
    got = s.quantiles(np.array([0.5]))
    assert np.isnan(got[0]) if not values else got[0] == 5.0


def test_one_key_with_most_values(spark):
    """A key with nine tenths of all values costs each task one summary, however many batches it reads."""
    df = spark.range(400_000, numPartitions=4).selectExpr("if(id % 10 < 9, 'hot', cast(id % 7 as string)) as k", "cast(hash(id) % 100000 as double) as x")
    first = df.select("k", F.col("x").alias("value")).mapInArrow(_from_values(["k"], 256), "k string, " + SUMMARY)
    sizes = first.groupBy("k").agg(F.count("*").alias("rows"), F.sum(F.size("tail") + 256 * F.size("levels")).alias("kept")).collect()
    hot = next(r for r in sizes if r["k"] == "hot")
    assert hot["rows"] == 4 and hot["kept"] < 4 * 256 * 12
    row = percentiles(summarise(df, ["k"], "x", 256), ["k"], {"p50": 0.5}, 256).where("k = 'hot'").first()
    values = np.sort([r["x"] for r in df.where("k = 'hot'").collect()])
    assert row["n"] == len(values) and row["rank_error"] <= len(values) * np.log2(len(values) / 256) / 512 + 4
    low, high = np.searchsorted(values, row["p50"], "left"), np.searchsorted(values, row["p50"], "right")
    assert low - row["rank_error"] <= (len(values) + 1) // 2 <= high + row["rank_error"]


def test_buffer_for_an_error():
    assert buffer_size(0.005, 10**6) == 1024 and buffer_size(0.005, 10**12) > 1024
