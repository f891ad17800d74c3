"""Worked examples and edge cases of the evaluation operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airledger.functions import aqi
from airledger.functions.stats import esd_limit, t_p_value, t_quantile
from airledger.operators import abstain, calibrate, ceiling, clean, duplicates, pictures, pipeline, ranks, scores, shares, splits
from airledger.operators.graph import connected_components


def column(spark, values, f, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def near(a, b, tol=1e-6):
    return abs(a - b) <= tol


def test_index(spark):
    got = column(spark, [35.4, 9.0, 12.05, 600.4, None, float("nan"), -1.0, 0.0], aqi.pm25_to_aqi)
    assert near(got[0], 100) and near(got[1], 37.5) and got[2] < 51 and near(got[3], 401 + 99 * (600.4 - 350.5) / (500.4 - 350.5)) and got[4:7] == [None] * 3 and got[7] == 0
    assert near(column(spark, [9.0], lambda x: aqi.pm25_to_aqi(x, 2024))[0], 50)
    assert near(column(spark, [150.0], lambda x: aqi.pm25_to_aqi(aqi.aqi_to_pm25(x)))[0], 150)
    assert column(spark, [39.0, 160.0, 50.0, 50.5, -3.0, float("nan"), None, 20000.0], aqi.category) == ["Good", "Unhealthy", "Good", "Moderate", "Good", "Hazardous", None, "Hazardous"]
    assert column(spark, [49.9, 50.0, 300.0, None, float("nan")], aqi.band) == [0, 1, 5, None, None]


def test_t_and_limits():
    assert near(float(t_quantile(0.975, 4)), 2.776445105)
    assert np.allclose(esd_limit(np.full(10, 54), np.arange(1, 11)), [3.159, 3.151, 3.144, 3.136, 3.128, 3.120, 3.112, 3.103, 3.094, 3.085], atol=6e-4)
    assert np.isnan(esd_limit(np.array([2]), np.array([1]))).all()
    assert near(t_p_value(0.5, 20), 0.024768, 1e-4) and math.isnan(t_p_value(0.5, 2))


def test_points_and_bands(spark):
    cases = [([10, 20, 30, 40, 50], [14, 18, 30, 42, 46], 0.96), ([10, 20, 30, 40, 50], [50, 40, 30, 20, 10], -3.0), ([10, 20, 30, 40, 50], [30] * 5, 0.0), ([50, 100, 150, 200, 250], [70, 110, 140, 190, 240], 0.968), ([5, 5], [4, 6], None)]
    for y, p, r2 in cases:
        row = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double").agg(*scores.point_scores(F.col("y"), F.col("p"))).first()
        assert row["r2"] == r2
    row = spark.createDataFrame([(0.0, e) for e in (5.0, 5.0, 5.0, 5.0, 60.0)], "y double, p double").agg(*scores.point_scores(F.col("y"), F.col("p"))).first()
    assert row["mae"] == 16 and near(row["rmse"], math.sqrt(740), 1e-5)
    loss = scores.pinball(spark.createDataFrame([(100.0, 80.0)], "y double, q double"), "y", {"q": 0.95}).first()
    assert near(loss["pinball"], 19)
    bands = scores.error_by_band(spark.createDataFrame([(-1.0, 0.0), (0.0, 1.0), (50.0, 53.0), (10000.0, 0.0)], "y double, p double"), "y", "p").collect()
    assert {(r["band"], r["mae"], r["n"]) for r in bands} == {("0-50", 1.0, 1), ("50-100", 3.0, 1)}


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1.0, 2.0, 2.5, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)
    got = {r["k"]: r["rank"] for r in ranks.with_row_number(df, [F.col("v"), F.col("k")]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [got[k] for k, _ in order] == list(range(1, 201))
    fine = df.where("v is not null")
    mean = {r["k"]: r["r"] for r in ranks.with_average_rank(fine, "v", "r").collect()}
    values = sorted(v for _, v in rows if v is not None)
    for k, v in rows:
        if v is not None:
            places = [i + 1 for i, x in enumerate(values) if x == v]
            assert mean[k] == sum(places) / len(places)
    run = {r["k"]: r["running"] for r in ranks.with_running_sum(fine, [F.col("v"), F.col("k")], F.col("v")).collect()}
    total = 0.0
    for k, v in order:
        if v is not None:
            total += v
            assert near(run[k], total)
    assert ranks.with_row_number(df.limit(0), [F.col("k")]).collect() == []


@pytest.mark.parametrize("errors, q", [([-40, -22, -10, -3, 5, 18], 18), ([-30, -10, 5, 40, 100], 100)])
def test_conformal_examples(spark, errors, q):
    cal = spark.createDataFrame([(float(-e), 0.0, 1e9) for e in errors], "y double, low double, high double")
    assert calibrate.conformal_q(cal, "y", "low", "high").first()["q"] == q


@pytest.mark.parametrize("n, rank", [(10, 10), (19, 19), (100, 92), (1, 1)])
def test_conformal_rank(spark, n, rank):
    cal = spark.createDataFrame([(float(-e), 0.0, 1e9) for e in range(1, n + 1)], "y double, low double, high double")
    assert calibrate.conformal_q(cal, "y", "low", "high").first()["q"] == rank
    wide = calibrate.widen(spark.createDataFrame([(95.0, 130.0, 190.0), (10.0, 1.0, 2.0)], "q05 double, q50 double, q95 double"), spark.createDataFrame([(30.0,)], "q double"), "q05", "q95").collect()
    assert [(r["q05"], r["q95"]) for r in wide] == [(65.0, 220.0), (0.0, 32.0)]
    assert calibrate.conformal_q(cal.limit(0), "y", "low", "high").collect() == []


def test_isotonic(spark):
    rng = random.Random(2)
    pts = [(float(rng.randint(0, 300)), rng.gauss(0, 30)) for _ in range(700)]
    pts = [(x, x / 3 + e) for x, e in pts]
    df = spark.createDataFrame(pts, "x double, y double")
    whole, cut = (calibrate.knots(calibrate.isotonic_fit(df, "x", "y", block=b)) for b in (10**6, 16))
    assert np.allclose(np.interp(np.arange(301), *whole), np.interp(np.arange(301), *cut))
    xs = sorted({x for x, _ in pts})
    means = np.array([np.mean([y for a, y in pts if a == x]) for x in xs])
    w = np.array([sum(a == x for a, _ in pts) for x in xs], dtype=float)
    sums, weights = np.concatenate([[0], np.cumsum(means * w)]), np.concatenate([[0], np.cumsum(w)])
    fit = [max(min((sums[j + 1] - sums[i]) / (weights[j + 1] - weights[i]) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]
    assert np.allclose(np.interp(xs, *whole), np.maximum(fit, 0))
    got = column(spark, [260.0, 100.0, 400.0, None], lambda x: calibrate.apply_knots(x, [200.0, 300.0], [210.0, 360.0]))
    assert got == [300.0, 210.0, 360.0, None]
    assert calibrate.isotonic_fit(df.limit(0), "x", "y").collect() == []
    points = spark.createDataFrame([(i, p) for i, p in enumerate([-5.0, 0.0, 3.3, 17.25, 1e9, None, float("nan")])], "i int, p double")
    xs, ys = cut
    got = {r["i"]: r["p"] for r in calibrate.apply_fit(points, calibrate.isotonic_fit(df, "x", "y"), "p", "p").collect()}
    want = {r["i"]: r["p"] for r in points.select("i", calibrate.apply_knots(F.col("p"), xs, ys).alias("p")).collect()}
    assert got.keys() == want.keys() and all(got[i] is want[i] is None or abs(got[i] - want[i]) < 1e-9 for i in got)
    assert {r["p"] for r in calibrate.apply_fit(points, calibrate.isotonic_fit(df.limit(0), "x", "y"), "p", "p").collect()} == {None}


def test_isotonic_across_ranges(spark):
    """Labels that rise already (nothing pools), that fall (all pool into one), and both in turn, in ranges of 8."""
    n = 100
    shapes = {"up": range(n), "down": range(n, 0, -1), "saw": [k % 23 + k / 7 for k in range(n)]}
    for values in shapes.values():
        df = spark.createDataFrame([(float(k), float(v)) for k, v in enumerate(values)], "x double, y double")
        whole, cut = (calibrate.knots(calibrate.isotonic_fit(df, "x", "y", block=b)) for b in (1000, 8))
        assert whole[0] == cut[0] and max(abs(a - b) for a, b in zip(whole[1], cut[1])) < 1e-9


def test_nothing_to_calibrate_with(spark):
    rows = spark.createDataFrame([(1, 10.0, 20.0)], "i int, q05 double, q95 double")
    out = calibrate.widen(rows, spark.createDataFrame([], "q double"), "q05", "q95").collect()
    assert [tuple(r) for r in out] == [(1, None, None)]


def test_percentiles_of_a_hot_key(spark):
    """Nine tenths of all rows under one key, many of them equal; nulls in key and value."""
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), rng.choice([None, 5.0, rng.gauss(0, 9)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, x double")
    q = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in ranks.percentiles_by_key(df, ["k"], "x", q).collect()}
    for key in ("hot", "a", None):
        v = [x for k, x in rows if k == key and x is not None]
        assert got[key]["n"] == len(v) and all(abs(got[key][c] - np.percentile(v, 100 * p)) < 1e-9 for c, p in q.items())
    one = ranks.percentiles_by_key(df, [], "x", q).collect()
    v = [x for _, x in rows if x is not None]
    assert len(one) == 1 and one[0]["n"] == len(v) and abs(one[0]["p50"] - np.median(v)) < 1e-9
    none = ranks.percentiles_by_key(df.limit(0), [], "x", q).collect()
    assert [tuple(r) for r in none] == [(0, None, None, None, None, None)]


def hourly(spark):
    rng = random.Random(4)
    rows = [(s, f"2024-01-01T{h:02d}:00:00Z", max(0.1, rng.gauss(m, sd)), "x") for s, m, sd, n in (("A", 10, 3, 20), ("B", 60, 12, 20), ("C", 30, 5, 5)) for h in range(n)]
    return rows, "location_id string, datetime string, pm25_ugm3 double, station string"


def test_days(spark):
    rows, schema = hourly(spark)
    rows += [("A", "2024-01-01T21:00:00Z", x, "x") for x in (-5.0, None, 5000.0, float("nan"))] + [("A", "junk", 5.0, "x"), (None, "2024-01-01T21:00:00Z", 5.0, "x"), ("A", None, 1.0, "x")]
    fine = ceiling.clean_hourly(spark.createDataFrame(rows, schema))
    assert fine.count() == 45
    days = ceiling.per_day(fine).collect()
    assert {(r["station"], r["n_hours"]) for r in days} == {("A", 20), ("B", 20)}
    assert near(ceiling.deviations(fine).agg(F.sum("deviation")).first()[0], 0) and ceiling.deviations(fine).count() == 40
    with pytest.raises(ValueError, match="station-days"):
        ceiling.require_days(ceiling.per_day(fine.limit(0)))


def noise(spark, days, labels, impute=False):
    d = spark.createDataFrame([("s", i, 20, float(m), float(v)) for i, (m, v) in enumerate(days)], "station string, day int, n_hours int, day_mean_aqi double, within_day_var double")
    y = spark.createDataFrame([(x,) for x in labels], "y double")
    return ceiling.reweighted_variance(ceiling.noise_curve(d), ceiling.label_hist(y, "y"), impute).first()


def test_reweighting(spark):
    assert near(noise(spark, [(25, 100), (25, 100), (75, 400), (75, 400)], [25.0] * 3 + [75.0])["var_epsilon"], 175)
    labels = [25.0] * 20 + [75.0] * 20 + [250.0] * 30 + [400.0] * 30
    days = [(25, 90), (25, 90), (75, 150), (75, 150)]
    assert near(noise(spark, days, labels)["var_epsilon"], 120) and near(noise(spark, days, labels, True)["var_epsilon"], 264)
    hist = ceiling.label_hist(spark.createDataFrame([(10.0,), (20.0,), (float("nan"),), (None,), (30.0,), (float("inf"),)], "y double"), "y").collect()
    assert near(sum(r["p"] for r in hist), 1) and len(hist) == 6 and {r["band_idx"]: r["p"] for r in hist}[5] == 0
    assert noise(spark, days, [float("nan")])["var_epsilon"] is None


def test_r2max(spark):
    got = spark.range(1).select(ceiling.r2_max(F.lit(175.0), F.lit(2500.0)), ceiling.r2_max(F.lit(208.6), F.lit(11708.0)), ceiling.r2_max(F.lit(5.0), F.lit(0.0)), ceiling.r2_max(F.lit(9.0), F.lit(1.0))).first()
    assert near(got[0], 0.93) and near(got[1], 0.982, 1e-3) and got[2] is None and got[3] == 0
    devs = [-30, -10, 0, 10, 30, -20, 20, 5, -5, 15]
    floor = ceiling.interval_floor(spark.createDataFrame([(float(x),) for x in devs], "deviation double")).first()[0]
    assert near(floor, np.percentile(devs, 95) - np.percentile(devs, 5))


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randint(0, 200), 1000 + rng.randint(0, 200)) for _ in range(120)] + [(5000, i) for i in range(2000, 2200)] + [(7, 7), (None, 3), (9000, 9000), (9001, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprints(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = []
    for i in range(300):
        h = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            h ^= 1 << b
        prints.append(h - 2**64 if h >> 63 else h)
    rows = [(i, h, "x") for i, h in enumerate(prints)] + [(1000, None, "x"), (1001, None, "x")]
    df = spark.createDataFrame(rows, "_row long, phash long, print string")
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(a, b): far(a, b) for a, b in itertools.combinations(sorted(set(prints)), 2) if far(a, b) <= 5}
    got = duplicates.near_pairs(df).collect()
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want)
    for a, b in list(want)[:50]:  # whatever mask two agree under, they agree under one of those it is divided into
        mask = 0
        while masks := duplicates.block_masks(mask, 5):
            mask = next(m for m in masks if (a ^ b) & m == 0)
    groups = {r["_row"]: r["dup_group"] for r in duplicates.near_groups(df).collect()}
    assert groups[1000] == 1000 and len(groups) == 302
    report = duplicates.redundancy_report(duplicates.near_groups(df)).first()
    assert report["n_images"] == 302 and report["n_groups"] == len(set(groups.values()))
    assert duplicates.near_groups(df.limit(0)).collect() == []


def test_fingerprints_in_full_buckets(spark, monkeypatch):
    """Fingerprints that share most bits fill their buckets, which are then divided again and again."""
    rng = random.Random(7)
    prints = sorted({(0x5A5A << 48 | sum(1 << b for b in rng.sample(range(48), rng.randint(0, 7)))) for _ in range(700)})
    want = {(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 5}
    monkeypatch.setattr(duplicates, "FULL", 40)
    monkeypatch.setattr(duplicates, "COUNTED", 1)
    got = [(r[0], r[1]) for r in duplicates.near_pairs(spark.createDataFrame([(p,) for p in prints], "phash long")).collect()]
    assert set(got) == want and len(got) == len(want)


def photo_rows(n=90):
    return [(i, i // 3, f"2024-01-{1 + i % 28:02d}T00:00:00", float(-60 + i), float(i * 3 - 130), float(i % 7 * 60), "test" if (i // 3) % 5 == 0 else "train", i // 2) for i in range(n)]


PHOTOS = "_row long, station_id long, captured_at string, latitude double, longitude double, pm25 double, orig_split string, image_id long"


def test_splits(spark):
    df = spark.createDataFrame(photo_rows(), PHOTOS)
    for f in (splits.random_split, splits.temporal_split, splits.station_split, splits.geographic_split, splits.shipped_split):
        out = f(df)
        assert out.count() == 90 and out.select("_row").distinct().count() == 90
        report = splits.split_report(out).first()
        assert sum(report[f"n_{s}"] for s in splits.SHARES) == 90
        if f in (splits.station_split, splits.shipped_split):
            assert report["straddling"] == 0 and splits.straddling(out).count() == 0
    assert splits.split_report(splits.random_split(df)).first()["n_train"] == round(0.65 * 90)
    folds = splits.cv_folds(df).collect()
    tests = [r for r in folds if r["role"] == "test"]
    assert len(tests) == 30 and len({r["station_id"] for r in tests}) == 30 and len(folds) == 150
    for k in range(5):
        assert 0.1 < sum(r["n"] for r in tests if r["fold"] == k) / 90 < 0.3
    halves = splits.half_split(df).collect()
    assert sum(r["part"] == "fit" for r in halves) == 15
    for f in (splits.random_split, splits.station_split, splits.temporal_split):
        assert f(df.limit(0)).collect() == []


def test_shares_with_a_giant(spark):
    groups = spark.createDataFrame([("giant", 5000)] + [(f"g{i}", 1 + i % 2) for i in range(6000)], "component string, n long")
    out = shares.fill_shares(groups, {"a": 0.5, "b": 0.3, "c": 0.2}).groupBy("split").agg(F.sum("n").alias("n")).collect()
    total = 5000 + 9000
    got = {r["split"]: r["n"] / total for r in out}
    assert all(abs(got[s] - x) < 0.002 for s, x in (("a", 0.5), ("b", 0.3), ("c", 0.2)))


def test_cleaning(spark):
    rows = [(3, 1, "c"), (1, 1, "a"), (2, None, "b"), (5, None, "e"), (4, 2, "d")]
    df = spark.createDataFrame(rows, "_row long, image_id long, quality string").withColumn("image", F.lit(b"x"))
    assert sorted(r["_row"] for r in clean.keep_first(df).where("image_id is not null").collect()) == [1, 4]
    assert clean.duplicates_removed(df).first()[0] == 2
    out = clean.shuffled(clean.drop_dead(clean.metadata(df)))
    assert out.columns == ["_row", "image_id", "position"] and sorted(r["position"] for r in out.collect()) == [0, 1, 2, 3, 4]
    assert clean.exact_sample(df, 2).count() == 2 and clean.exact_sample(df, 99).count() == 5
    assert {r["orig_split"] for r in clean.pooled({"train": df, "test": df.drop("quality")}).collect()} == {"train", "test"}
    assert clean.violations(df, image=F.col("image_id").isNotNull()).first()["image"] == 2


def test_sampling_by_weight(spark):
    df = spark.createDataFrame([(i, 9.0 if i < 10 else 1.0) for i in range(100)], "_row long, w double")
    draws = splits.weighted_sample(df, "w", 4000).collect()
    assert len(draws) == 4000
    assert abs(sum(r["_row"] < 10 for r in draws) / 4000 - 0.5) < 0.03
    weights = splits.balanced_weights(spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 120.0), (4, None)], "_row long, y double"), aqi.band(F.col("y")), 1.0).collect()
    assert {r["_row"]: r["weight"] for r in weights} == {1: 0.5, 2: 0.5, 3: 1.0, 4: 1.0}


def test_contamination(spark):
    test = spark.createDataFrame([(2, "a", 80.0, 82.0, 2), (3, "a", 90.0, 88.0, 3), (4, "b", 100.0, 102.0, 4), (5, "b", 110.0, 108.0, None), (6, "c", 40.0, 55.0, 6), (7, None, 60.0, 45.0, 7)], "_row long, station_id string, y double, p double, dup_group long")
    train = spark.createDataFrame([(0, "a", 0), (1, "a", 1), (9, None, None)], "_row long, station_id string, dup_group long")
    marked = scores.contamination(test, train)
    got = {r["contaminated"]: r for r in scores.contaminated_vs_clean(marked, "y", "p").collect()}
    assert got[True]["n"] == 2 and got[False]["n"] == 4 and got[True]["r2"] is None and got[False]["mae"] is None
    assert scores.contamination(test, train.limit(0)).where("contaminated").count() == 0


def test_folds(spark):
    s = scores.t_interval([0.20, 0.24])
    assert near(s["mean"], 0.22) and s["low"] < 0.22 < s["high"]
    assert scores.nadeau_bengio([0.2])["low"] == 0.2 and scores.nadeau_bengio([0.2, 0.24])["low"] < s["mean"]
    df = spark.createDataFrame([(0, 0.20), (1, 0.24)], "fold int, r2 double")
    row = scores.summarise_folds(df, "fold", ["r2"]).first()
    assert near(row["mean"], 0.22) and near(row["low"], s["low"], 1e-5) and near(row["nb_low"], scores.nadeau_bengio([0.2, 0.24], 0.5)["low"], 1e-5)


def test_thresholds_and_gate(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(5, 1, 500), np.concatenate([np.zeros(950), rng.uniform(0.1, 1, 50)])):
        df = spark.createDataFrame([(float(v),) for v in values], "s double")
        tau = abstain.ood_threshold(df, "s").first()["tau"]
        assert (values > tau).mean() <= 0.05
        assert near(abstain.width_threshold(df, "s").first()["tau"], np.percentile(values, 90))
    none = abstain.ood_threshold(df.limit(0), "s").first()  # nothing to judge by: nothing is refused
    assert none["n"] == 0 and none["tau"] == math.inf
    gate = abstain.decide(F.col("s"), F.col("w"), F.lit(0.5), F.lit(1.0), F.lit("strange"))
    rows = spark.createDataFrame([(0.9, 9.0), (0.5, 9.0), (0.5, 1.0)], "s double, w double").select(gate.alias("g")).select("g.*").collect()
    assert [(r["answer"], r["reason"]) for r in rows] == [(False, "strange"), (False, "interval too wide"), (True, "ok")]


def test_risk(spark):
    rng = np.random.default_rng(2)
    e = rng.exponential(size=400)
    u = e + rng.normal(0, 0.5, 400)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(u, e, rng.random(400)))], "k long, u double, e double, noise double")
    curve = [r["risk"] for r in abstain.risk_coverage(df, "u", "e", "k").orderBy("rank").collect()]
    want = np.cumsum(e[np.argsort(u, kind="stable")]) / np.arange(1, 401)
    assert np.allclose(curve, want)
    good, poor = (abstain.risk_areas(df, c, "e", "k").first() for c in ("u", "noise"))
    assert near(good["aurc"], np.trapezoid(want, np.arange(1, 401) / 400)) and good["aurc"] < poor["aurc"] and good["excess_aurc"] >= 0
    assert abstain.most_confident(df, "u", "k", 0.8).count() == 320


def test_ood(spark):
    rows = [(1.0, False), (2.0, False), (3.0, False), (4.0, True), (5.0, True), (6.0, True)]
    got = abstain.ood_metrics(spark.createDataFrame(rows, "s double, o boolean"), "s", "o").first()
    assert (got["auroc"], got["aupr"], got["fpr95"]) == (1.0, 1.0, 0.0)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 16)), rng.normal(3, 1, (120, 16))])
    df = spark.createDataFrame([(i, [float(v) for v in row], i >= 300) for i, row in enumerate(x)], "id long, v array<double>, o boolean")
    fitted = abstain.fit_mahalanobis(df.where("not o"), "v")
    scored = df.select("id", "o", abstain.mahalanobis(F.col("v"), fitted).alias("s"))
    assert abstain.ood_metrics(scored, "s", "o").first()["auroc"] > 0.9
    z = x[:300] - x[:300].mean(0)
    assert np.allclose(fitted["mean"], x[:300].mean(0)) and 0 <= fitted["shrinkage"] <= 1
    cov = z.T @ z / 300
    shrunk = (1 - fitted["shrinkage"]) * cov + fitted["shrinkage"] * np.trace(cov) / 16 * np.eye(16)
    assert np.allclose(fitted["precision"] @ shrunk, np.eye(16), atol=1e-8)
    got = {r["id"]: r["distance"] for r in abstain.knn_distance(df.where("id % 100 = 0"), df, "id", "v", k=5, block=3).collect()}
    for i in (0, 100, 200, 300, 400):
        assert near(got[i], np.sort(np.linalg.norm(x - x[i], axis=1))[4])


def test_pictures(spark):
    rng = np.random.default_rng(4)
    rgb = np.round(rng.random((9, 12, 3)), 3)
    pixels = spark.createDataFrame([(1, y, x, *map(float, rgb[y, x])) for y in range(9) for x in range(12)], "image long, y int, x int, r double, g double, b double")
    want = pictures.transmission(rgb, patch=5, top_share=0.001)
    got = np.zeros((9, 12))
    for r in pictures.transmission_pixels(pixels, patch=5).collect():
        got[r["y"], r["x"]] = r["t"]
    assert np.allclose(got, want) and want.min() >= 0.05 and want.max() <= 1
    s = np.zeros((9, 12))
    for r in pixels.select("y", "x", pictures.inverse_saturation(F.col("r"), F.col("g"), F.col("b")).alias("s")).collect():
        s[r["y"], r["x"]] = r["s"]
    assert np.allclose(s, pictures.inverse_saturation_map(rgb))
    stats = pictures.picture_stats(pixels).first()
    assert near(stats["brightness"], rgb.mean()) and near(stats["detail"], rgb.mean(2).var())
    for value, dark in ((0.0, True), (0.6, False)):
        b, v = F.lit(value), F.lit(0.0)
        row = spark.range(1).select(abstain.handcrafted_score(b, v), abstain.handcrafted_reason(b, v)).first()
        assert row[0] > 0.8 and row[1] == ("too dark" if dark else "too flat")
    assert np.allclose(pictures.resize(np.full((30, 40, 3), 0.4), 16), 102 / 255)
    gray = rng.random((48, 64))
    assert abs(pictures.phash(gray)) < 2**63
    noisy = np.clip(gray + rng.normal(0, 0.005, gray.shape), 0, 1)
    assert ((pictures.phash(gray) ^ pictures.phash(noisy)) & (2**64 - 1)).bit_count() <= 8
    df = spark.createDataFrame([(1, 9, 12, [float(v) for v in rgb.ravel()]), (2, 9, 12, None), (3, 2, 2, [0.0])], "image long, height int, width int, rgb array<double>")
    out = {r["image"]: r for r in pictures.picture_features(df, size=16, patch=3).collect()}
    assert out[2]["phash"] is None and out[3]["mean_t"] is None and len(out[1]["maps"]) == 2 * 16 * 16
    assert [len(r["tensor"]) for r in pictures.five_channel_table(df, size=16, patch=3).collect()] == [5 * 16 * 16]
    maps = pictures.picture_features(df, size=16, patch=3)
    assert pictures.verify_maps(maps, maps).first()["aligned"]
    other = maps.withColumn("maps", F.when(F.col("maps").isNotNull(), F.lit(bytes(512))))
    assert not pictures.verify_maps(maps, other).first()["aligned"]


def test_model_outputs(spark):
    steps = calibrate.monotone_quantiles(F.lit(1.0), [F.lit(-50.0), F.lit(800.0)])
    row = spark.range(1).select(*steps).first()
    assert row[0] <= row[1] <= row[2] and near(row[2], 801, 1e-6)
    members = spark.createDataFrame([(1, 10.0), (1, 1000.0), (2, 5.0)], "k long, q double")
    assert {r["k"]: round(r["q"], 6) for r in calibrate.ensemble_mean(members, "k", ["q"]).collect()} == {1: 100.0, 2: 5.0}
    row = spark.createDataFrame([(1.0,), (3.0,)], "y double").transform(lambda d: calibrate.target_stats(d, "y")).first()
    assert near(row["y_mean"], 2) and near(row["y_std"], 1 + 1e-6, 1e-9)
    lr = [r[0] for r in spark.range(5).select(calibrate.cosine_warmup(F.col("id"), 2, 4)).collect()]
    assert lr[0] == 0.5 and lr[1] == 1.0 and near(lr[4], 0)


def test_pipeline(spark):
    df = spark.createDataFrame(photo_rows(), PHOTOS)
    for s in pipeline.STRATEGIES:
        assert pipeline.make_splits(df, s).where(f"strategy = '{s}' and split is not null").count() == 90
    with pytest.raises(ValueError, match="unknown"):
        pipeline.make_splits(df, "other")
    with pytest.raises(ValueError, match="sum"):
        pipeline.make_splits(df, shares={"train": 0.5, "cal": 0.1, "test": 0.1})
    with pytest.raises(ValueError, match="needs"):
        pipeline.make_splits(df.withColumn("station_id", F.lit(None).cast("long")))
    with pytest.raises(ValueError, match="station came"):
        pipeline.make_splits(df.withColumn("station_id", F.lit(1)), "shipped")
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        y = float(rng.uniform(10, 200))
        p = y + float(rng.normal(0, 15))
        rows.append((i, i // 3, ["train", "cal", "test"][(i // 3) % 3], y, p - 10, p, p + 10, p))
    pred = spark.createDataFrame(rows, "row_id long, station_id long, split string, y double, q05 double, q50 double, q95 double, point double")
    row = pipeline.evaluate_split(pred).first()
    assert 0.85 <= row["coverage"] <= 0.97 and row["r2"] > 0.85 and row["straddling"] == 0 and (row["n_train"], row["n_test"]) == (300, 300)
    assert abs(row["r2"] - (1 - (row["rmse"] / row["sd_y"]) ** 2)) < 1e-5
    down = spark.createDataFrame([(i, float(i), -2.0 * i + (i % 3)) for i in range(60)], "k long, a double, b double")
    corr = pipeline.label_correlation(down, "a", "b", "k", 40).first()
    assert corr["n"] == 40 and corr["passes"] and corr["pearson_p"] < 1e-6
    same = pipeline.score_batches(down, lambda: lambda pdf: pdf.assign(c=pdf["a"] * 2)[["k", "c"]], "k long, c double")
    assert same.agg(F.sum("c")).first()[0] == 2 * sum(range(60))
    huber = spark.range(1).agg(pipeline.combined_loss(F.lit(100.0), {"q": (F.log(F.lit(100.0)), 0.5)}, F.lit(3.0), 100.0, 1.0, huber=1.0)).first()[0]
    assert near(huber, 2.5)


def test_last_before(spark):
    rng = random.Random(9)
    marks = [(rng.choice([None, *map(float, range(50))]), i) for i in range(40)]
    rows = [(i, rng.choice([None, rng.uniform(-5, 60), float(rng.randint(0, 50))])) for i in range(300)]
    got = {r["k"]: r["mark"] for r in ranks.with_last_before(spark.createDataFrame(rows, "k long, at double").repartition(4), spark.createDataFrame(marks, "at double, mark long"), "at", "mark").collect()}
    for k, at in rows:
        if at is not None:
            fit = [(a, m) for a, m in marks if a is not None and a <= at]
            assert got.pop(k) == (max(fit)[1] if fit else None)
    assert not got
    none = spark.createDataFrame([], "k long, at double")
    assert ranks.with_last_before(none, spark.createDataFrame(marks, "at double, mark long"), "at", "mark").collect() == []
    assert splits.weighted_sample(spark.createDataFrame([(1, 0.0)], "_row long, w double"), "w", 5).collect() == []
