import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from airledger.functions.stats import esd_limit
from airledger.operators import implausible
from airledger.operators.implausible import HALO, STRETCH, esd_floor, esd_limits, implausible_readings, pulse_height, running_median, seasonal_profile
from airledger.plans import general

H = 3_600_000_000
SCHEMA = "reading_id long, sensor_id long, utc_us long, aqi double, day string, x int"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40))
def test_trend_is_a_median_of_neighbours(values):
    x = np.array(values, dtype=float)
    n, width = len(x), min(len(x), 11)
    for k, got in enumerate(running_median(x)):
        start = min(max(k - 5, 0), max(n - 11, 0))
        assert got == np.median(x[start : start + width])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.integers(1, 3))
def test_outliers_step_by_step(sizes, scale):
    """The test as it is stated: take the most extreme value away, again and again; the last one beyond its limit decides."""
    left, outliers, gone = sorted(sizes), 0, []
    for i in range(1, len(sizes) // 2 + 1):
        gone.append(left.pop())
        limit = float(esd_limit(np.array([len(sizes)]), np.array([i]))[0]) if len(sizes) - i + 1 >= 3 else np.inf
        if gone[-1] > limit * scale:
            outliers = i
    floor = esd_floor(np.array(sizes, dtype=float), float(scale), esd_limits(100, 0.05))
    assert floor == (gone[outliers - 1] if outliers else np.inf)


def test_season_by_hand():
    off, hour = np.array([1.0, 2, 9, 3, 0, 1, 8, 4, 5, 7]), np.array([3] * 7 + [5, 5, 7])
    got = seasonal_profile(off, hour)
    assert got[3] == 2 and not np.delete(got, 3).any()  # hours with fewer than seven readings have no part of their own


def test_height_by_hand():
    x = np.array([1.0, 1, 50, 60, 1, 2, -40, 3, 3])
    assert list(pulse_height(x, 3)[2:4]) == [49.0, 49.0]  # alone, 60 stands 10 over 50; together both stand 49 over 1


def made(seed, sensors=25, n=120):
    rng = random.Random(seed)
    rows, i = [], 0
    for s in range(sensors):
        level, t = rng.uniform(20, 200), 0
        length = rng.choice([1, 2, 3, 4, 5, 7, n])
        k = 0
        while k < length:
            t += rng.choice([1, 1, 1, 5]) * H
            level += rng.gauss(0, 3)
            kind = rng.random()
            if kind < 0.03:
                burst = rng.randint(1, 4)
                jump = rng.choice([-1, 1]) * rng.uniform(10, 120)
                values = [round(level + jump + rng.gauss(0, 1), 1) for _ in range(burst)]
            elif kind < 0.05:
                values = [round(level, 1)] * rng.randint(6, 10)
            else:
                values = [rng.choice([round(level, 1)] * 40 + [-5.0, 700.0, None, float("nan")])]
            for v in values:
                t += H
                k += 1
                copies = 2 if rng.random() < 0.1 else 1
                for _ in range(copies):
                    rows.append((i, s, t if rng.random() < 0.97 else None, v, "d", 1))
                    i += 1
    return rows


def flagged(spark, rows):
    return {r["delivery"] for r in implausible_readings(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_like_row_by_row(spark, seed):
    rows = made(seed)
    assert flagged(spark, rows) == brute.implausible([r[:4] for r in rows])


def test_one_long_source(spark):
    """Runs and spikes across the borders of stretches."""
    rng = random.Random(3)
    n = 2 * STRETCH + 500
    x = [100 + 5 * rng.random() + 10 * (k % 24 > 12) for k in range(n)]
    for k in (STRETCH - 1, STRETCH, STRETCH + 1, 2 * STRETCH - 2, 2 * STRETCH - 1, 5000):
        x[k] += 400
    for k in range(2 * STRETCH - 40, 2 * STRETCH - 32):
        x[k] = 77.0
    for k in range(STRETCH - 20, STRETCH - 20 + HALO):
        x[k] = 55.0
    rows = [(k, 7, k * H, v, "d", 1) for k, v in enumerate(x)]
    got = flagged(spark, rows)
    assert got == brute.implausible([r[:4] for r in rows])
    assert {STRETCH, 2 * STRETCH - 36, 5000} <= got


def test_edges(spark):
    assert flagged(spark, []) == set()
    rows = [(1, 1, None, -1.0, "d", 1), (2, 1, 5 * H, float("nan"), None, 1), (3, 2, H, 5.0, "d", 1), (4, None, H, 5.0, "d", 1), (5, None, 2 * H, 500.0, "d", None), (6, None, 3 * H, 5.0, "d", 1), (7, 1, H, 601.0, "d", 1)]
    rows += [(10 + k, 3, k * H, 9.0, "d", 1) for k in range(8)] + [(30 + k, 4, k * H, 9.0, "d", 1) for k in range(7)]
    rows += [(50, 3, 0, 9.0, "d", 1), (51, 3, 0, None, "d", 1)]
    assert flagged(spark, rows) == {1, 7, *range(10, 18), 50}


def test_whole_table_like_row_by_row(spark, small):
    rows = [tuple(r) for r in general.timed_readings(spark, small).select("reading_id", "sensor_id", "utc_us", "aqi").collect()]
    got = [r[0] for r in general.p4_found(spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.implausible(rows)


def restless(sensor, first, spike):
    """A sensor that is stuck for most of its time, so that its median change is 0.1 while it moves by
    some 5 when it moves; one reading really stands out."""
    rng = random.Random(sensor)
    x = [50 + rng.gauss(0, 5) for _ in range(60)]
    for k in range(9):
        x += [60 + k + 0.1 * (j % 2 * (j // 2 % 2)) for j in range(12)]
        x += [50 + rng.gauss(0, 5) for _ in range(2)]
    x[spike] = 400.0
    return [(first + k, sensor, k * H, round(v, 1), "d", 1) for k, v in enumerate(x)]


def test_outlier_test_decides(spark, monkeypatch):
    """Plain movement that is tall against a median change pressed down by dull stretches is no outlier:
    without the test the stated height alone would flag it."""
    rows = restless(1, 0, 30)
    with_test = flagged(spark, rows)
    monkeypatch.setattr(implausible, "esd_floor", lambda size, scale, limits: 0.0)
    without = flagged(spark, rows)
    assert 30 in with_test and with_test < without


@pytest.mark.parametrize("stretch", [16, 100])
def test_stretches_like_whole_sources(spark, monkeypatch, stretch):
    rows = made(5) + restless(100, 10**6, 30) + restless(None, 10**7, 12)
    rows += [(10**8 + k, 200, k * H, 9.0, "d", 1) for k in range(200)]
    whole = sorted(tuple(r) for r in implausible_readings(spark.createDataFrame(rows, SCHEMA)).collect())
    monkeypatch.setattr(implausible, "STRETCH", stretch)
    cut = sorted(tuple(r) for r in implausible_readings(spark.createDataFrame(rows, SCHEMA), together=0).collect())
    assert cut == whole and {r for _, r in cut} == {"range", "stuck", "spike"}


def test_one_source_with_most_rows(spark, small):
    """A sensor with nine tenths of all rows, among them one reading delivered many times."""
    base = general.timed_readings(spark, small).where("reading_id % 3 = 0").select("reading_id", "sensor_id", "utc_us", "aqi")
    hot = base.where("sensor_id is not null").selectExpr("reading_id", "case when reading_id % 10 < 9 then -1 else sensor_id end as sensor_id", "utc_us", "aqi")
    rows = hot.unionByName(spark.range(6000).selectExpr("10000000 + id as reading_id", "-1L as sensor_id", "1700000000000000L as utc_us", "5.0D as aqi"))
    cut = {tuple(r) for r in implausible_readings(rows).collect()}
    whole = {tuple(r) for r in implausible_readings(rows, together=20000).collect()}
    assert cut == whole and len(cut) > 50
