import brute
from airledger.operators.grid import hour_text, hourly_grid, missing_hours
from airledger.plans import general
from pyspark.sql import functions as F

H = 3_600_000_000
SCHEMA = "sensor_id long, utc_us long, aqi double, reading_id long, source string, hour int"


def rows(*items):
    return [(s, t, x, i, "x", 1) for i, (s, t, x) in enumerate(items)]


def grid(spark, items, **kw):
    out = hourly_grid(spark.createDataFrame(rows(*items), SCHEMA), **kw).collect()
    assert len({(r["source"], r["hour"]) for r in out}) == len(out)
    return {(r["source"], r["hour"]): (r["value"], r["status"], r["gap_hours"]) for r in out}


def test_fill_mark_and_average(spark):
    items = [(1, 10 * H + 5, 10.0), (1, 10 * H + 6, 20.0), (1, 13 * H, 45.0), (1, 23 * H, 5.0), (1, 24 * H, None), (1, 25 * H, float("nan")), (1, None, 3.0), (2, 5 * H, 1.0)]
    got = grid(spark, items, max_fill=3)
    assert got[1, 10] == (15.0, "observed", 0)
    assert got[1, 11] == (25.0, "filled", 2) and got[1, 12] == (35.0, "filled", 2)
    assert all(got[1, h] == (None, "gap", 9) for h in range(14, 23))
    assert set(got) == {(1, h) for h in range(10, 24)} | {(2, 5)}


def test_deliveries_count_once_and_null_source(spark):
    got = grid(spark, [(1, H, 10.0), (1, H, 99.0), (1, H + 1, 20.0), (None, H, 1.0), (None, 3 * H, 3.0)])
    assert got[1, 1] == (15.0, "observed", 0)
    assert got[None, 2] == (2.0, "filled", 1)


def test_boundaries_long_gaps_and_before_1970(spark):
    got = grid(spark, [(1, -5 * H, 1.0), (1, 9000 * H - 1, 2.0)], first_hour=-8, last_hour=9002)
    assert set(got) == {(1, h) for h in range(-8, 9003)}
    assert [got[1, h][1] for h in (-8, -6, -5, -4, 8998, 8999, 9000, 9002)] == ["outside", "outside", "observed", "gap", "gap", "observed", "outside", "outside"]


def test_empty(spark):
    assert grid(spark, [(1, None, 1.0)]) == {}
    assert hourly_grid(spark.createDataFrame([], SCHEMA), first_hour=0).collect() == []


def test_text(spark):
    got = spark.createDataFrame([(0,), (-1,), (476359,)], "h long").select(hour_text(F.col("h"))).collect()
    assert [r[0] for r in got] == ["1970-01-01T00:00:00Z", "1969-12-31T23:00:00Z", "2024-05-05T07:00:00Z"]


def test_whole_table_like_row_by_row(spark, small):
    timed = general.timed_readings(spark, small)
    items = [tuple(r) for r in timed.select("sensor_id", "utc_us", "aqi").collect()]
    got = [tuple(r) for r in missing_hours(hourly_grid(timed)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.missing(items)
