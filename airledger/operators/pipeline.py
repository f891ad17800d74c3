"""Whole evaluations: a split strategy by name, calibrated reports, comparisons, batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import t_p_value
from . import calibrate, scores, splits
from .clean import exact_sample, violations
from .ranks import with_row_number

STRATEGIES = ("station_grouped", "random", "geographic", "temporal", "shipped")


def make_splits(df: DataFrame, strategy: str = "station_grouped", shares: dict[str, float] = splits.SHARES, seed: int = 42) -> DataFrame:
    """`df` with `split` and `strategy`. Checked first: shares that sum to 1, a known strategy, and
    that the columns it needs have no nulls; after `shipped`, that no station came in both parts."""
    if abs(sum(shares.values()) - 1) > 1e-6:
        raise ValueError(f"shares sum to {sum(shares.values())}")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    needs = {"station_grouped": ["station_id"], "random": [], "geographic": ["latitude", "longitude"], "temporal": ["captured_at"], "shipped": ["station_id", "orig_split"]}[strategy]
    if needs:
        broken = violations(df, **{c: F.col(c).isNotNull() for c in needs}).first().asDict()
        if any(broken.values()):
            raise ValueError(f"{strategy} needs values: {broken}")
    if strategy == "random":
        out = splits.random_split(df, shares=shares, seed=seed)
    elif strategy == "temporal":
        out = splits.temporal_split(df, shares=shares)
    elif strategy == "geographic":
        out = splits.geographic_split(df, shares=shares, seed=seed)
    elif strategy == "shipped":
        parts = df.groupBy("station_id").agg(F.max(F.col("orig_split") == "test").alias("t"), F.max(F.col("orig_split") != "test").alias("o"))
        if not parts.where("t and o").isEmpty():
            raise ValueError("a station came both in test and in other parts")
        out = splits.shipped_split(df, shares=shares, seed=seed)
    else:
        out = splits.station_split(df, shares=shares, seed=seed)
    return out.withColumn("strategy", F.lit(strategy))


def compare_strategies(df: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """(strategy, ...): the split report of each strategy. `shipped` is reported as it came, with its
    straddling stations, where `make_splits` would refuse it."""
    made = lambda s: splits.shipped_split(df) if s == "shipped" else make_splits(df, s)
    reports = [splits.split_report(made(s)).withColumn("strategy", F.lit(s)) for s in strategies]
    return reduce(DataFrame.unionByName, reports)


def evaluate_split(pred: DataFrame, coverage: float = 0.9, recalibrate: bool = True) -> DataFrame:
    """One row of scores of the test rows of (split, station_id, y, q05, q50, q95, point).

    Rows of several members of an ensemble (column `member`, with row_id) are averaged first.
    What is fitted (isotonic knots, the conformal widening) comes from the cal rows only; without
    any, points and intervals are unknown, and so are their scores.
    """
    if "member" in pred.columns:
        pred = calibrate.averaged_outputs(pred, ["row_id", "split", "station_id", "y"], ["q05", "q50", "q95"], ["point"])
    cal, test = pred.where("split = 'cal'"), pred.where("split = 'test'")
    if recalibrate:
        test = calibrate.apply_fit(test, calibrate.isotonic_fit(cal, "point", "y"), "point", "point")
    wide = calibrate.widen(test, calibrate.conformal_q(cal, "y", "q05", "q95", coverage), "q05", "q95")
    report = scores.full_report(wide, "y", "point", "q05", "q95")
    sizes = pred.agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    apart = splits.straddling(pred).agg(F.count("*").alias("straddling"))
    return report.join(F.broadcast(sizes), how="cross").join(F.broadcast(apart), how="cross")  # one row each


def label_correlation(df: DataFrame, feature: str, label: str, key: str, n: int | None = 500, seed: int = 42) -> DataFrame:
    """One row (n, pearson, pearson_p, spearman, spearman_p, passes) on a seeded sample; it passes if the feature falls with the label."""
    sample = exact_sample(df, n, key, seed) if n else df
    r = scores.spearman(sample, feature, label)

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:  # on one row
        return pd.Series([None if pd.isna(a) else t_p_value(a, b) for a, b in zip(r, n)], dtype="float64")

    return r.select("n", "pearson", p("pearson", "n").alias("pearson_p"), "spearman", p("spearman", "n").alias("spearman_p"), (F.col("pearson") < 0).alias("passes"))


def combined_loss(y: Column, q_log: dict[str, tuple[Column, float]], z: Column, mean: float, std: float, weight: float = 1.0, huber: float | None = None) -> Column:
    """Mean pinball loss of log quantiles plus `weight` times the squared (or Huber) loss of the
    standardised point."""
    target = F.log(F.greatest(y, F.lit(1e-6)))
    losses = [F.greatest(q * (target - c), (q - 1) * (target - c)) for c, q in q_log.values()]
    e = F.abs(z - (y - mean) / std)
    point = e * e if huber is None else F.when(e <= huber, 0.5 * e * e).otherwise(huber * (e - 0.5 * huber))
    return F.avg(reduce(lambda a, b: a + b, losses) / float(len(losses))) + weight * F.avg(point)


def every_kth(df: DataFrame, order: list[Column], step: int, most: int) -> DataFrame:
    """Every `step`-th row along a total order from the first, at most `most` of them."""
    ranked = with_row_number(df, order, "__rank")
    return ranked.where(((F.col("__rank") - 1) % step == 0) & (F.col("__rank") <= step * most)).drop("__rank")


def nearest_rows(df: DataFrame, value: str, targets: dict[str, float], key: str) -> DataFrame:
    """(target, key, value): the row whose value is nearest to each of a few targets; ties go to the lowest key."""
    picks = [F.min_by(F.struct(F.col(key).alias("key"), F.col(value).alias("value")), F.struct(F.abs(F.col(value) - t), F.col(key))).alias(name) for name, t in targets.items()]
    one = df.where(F.col(value).isNotNull()).agg(*picks)
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("target"), F.col(n).alias("row")) for n in targets)))
    return one.select(rows.alias("r")).select("r.target", F.col("r.row.key").alias(key), F.col("r.row.value").alias(value))


def score_batches(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """An external model over batches of rows: `make` loads it once a task and returns its function."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in frames:
            yield model(pdf)

    return df.mapInPandas(run, schema)


def width_over_floor(low: Column, high: Column, floor: float = 35.0, limit: float = 1.2) -> tuple[Column, Column]:
    """Width of an interval over the floor that label noise sets, and whether it is close to it."""
    ratio = (high - low) / floor
    return ratio, ratio <= limit
