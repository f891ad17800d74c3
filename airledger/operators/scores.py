"""Scores of predictions: points, intervals, bands, categories, contamination, folds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aqi import category_index
from ..functions.stats import t_quantile
from .ranks import with_average_rank

SIX = 6


def _r(x: Column, digits: int = SIX) -> Column:
    return F.round(x, digits)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's coefficient; null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def point_scores(y: Column, p: Column) -> list[Column]:
    """n, mae, rmse, r2, r2_pearson, sd_y of points `p` for labels `y`; r2 is null where y is constant."""
    e = p - y
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    return [
        F.count(e).alias("n"),
        _r(F.avg(F.abs(e))).alias("mae"),
        _r(F.sqrt(F.avg(e * e))).alias("rmse"),
        _r(1 - F.try_divide(sse, F.when(sst > 0, sst))).alias("r2"),
        _r(F.pow(correlation(y, p), 2)).alias("r2_pearson"),
        _r(F.stddev_pop(y)).alias("sd_y"),
    ]


def interval_scores(y: Column, low: Column, high: Column) -> list[Column]:
    """coverage (both ends count) and mean width."""
    inside = F.when((y >= low) & (y <= high), 1.0).otherwise(0.0)
    return [_r(F.avg(inside)).alias("coverage"), _r(F.avg(high - low)).alias("mean_width")]


def category_score(y: Column, p: Column) -> Column:
    return _r(F.avg(F.when(category_index(y) == category_index(p), 1.0).otherwise(0.0))).alias("category_accuracy")


def full_report(df: DataFrame, y: str, point: str, low: str, high: str, by: list[str] | None = None) -> DataFrame:
    """All scores in one aggregate, per group of `by` or of the whole table."""
    y_, p, lo, hi = (F.col(c) for c in (y, point, low, high))
    return df.groupBy(*(by or [])).agg(*point_scores(y_, p), *interval_scores(y_, lo, hi), category_score(y_, p))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, pearson, spearman); equal values share their average rank. Rows with a null are left out."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    ranked = with_average_rank(with_average_rank(both, "a", "ra"), "b", "rb")
    return ranked.agg(F.count("*").alias("n"), _r(correlation(F.col("a"), F.col("b"))).alias("pearson"), _r(correlation(F.col("ra"), F.col("rb"))).alias("spearman"))


def error_by_band(df: DataFrame, y: str, p: str, edges: tuple[float, ...] = (0, 50, 100, 150, 200, 300, 10000)) -> DataFrame:
    """(band, mae, n) for the bands of labels that have rows; a band holds its lower edge."""
    name = None
    for a, b in zip(edges, edges[1:]):
        here = (F.col(y) >= a) & (F.col(y) < b)
        name = F.when(here, f"{a}-{b}") if name is None else name.when(here, f"{a}-{b}")
    return df.select(name.alias("band"), F.abs(F.col(p) - F.col(y)).alias("e")).where(F.col("band").isNotNull()).groupBy("band").agg(_r(F.avg("e")).alias("mae"), F.count("*").alias("n"))


def pinball(df: DataFrame, y: str, quantiles: dict[str, float]) -> DataFrame:
    """One row (n, pinball): mean loss over rows and quantile columns."""
    losses = []
    for column, q in quantiles.items():
        e = F.col(y) - F.col(column)
        losses.append(F.greatest(q * e, (q - 1) * e))
    each = sum(losses[1:], losses[0]) / float(len(losses))
    return df.agg(F.count("*").alias("n"), _r(F.avg(each)).alias("pinball"))


def contamination(test: DataFrame, others: DataFrame, station: str = "station_id", group: str = "dup_group") -> DataFrame:
    """`test` with `contaminated`: its station or its near-duplicate group occurs in `others`.

    Null stations and groups match nothing. Both sides of the existence joins are distinct keys.
    """
    stations = others.where(F.col(station).isNotNull()).select(F.col(station).alias("__s")).distinct().withColumn("__has_s", F.lit(True))
    groups = others.where(F.col(group).isNotNull()).select(F.col(group).alias("__g")).distinct().withColumn("__has_g", F.lit(True))
    marked = test.join(stations, F.col(station) == F.col("__s"), "left").join(groups, F.col(group) == F.col("__g"), "left")
    flag = F.coalesce("__has_s", F.lit(False)) | F.coalesce("__has_g", F.lit(False))
    return marked.withColumn("contaminated", flag).drop("__s", "__g", "__has_s", "__has_g")


def contaminated_vs_clean(marked: DataFrame, y: str, p: str, least: int = 5) -> DataFrame:
    """(contaminated, n, share, r2, mae, rmse, sd_y); scores are null for fewer than `least` rows."""
    scores = marked.groupBy("contaminated").agg(*point_scores(F.col(y), F.col(p)))
    whole = F.sum("n").over(Window.partitionBy())  # over at most two rows
    kept = [F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("r2", "mae", "rmse", "sd_y")]
    return scores.select("contaminated", "n", _r(F.col("n") / whole).alias("share"), *kept)


def t_interval(values: list[float], n_folds: int | None = None, ci: float = 0.95) -> dict[str, float]:
    """Mean, standard deviation and Student t interval of one score over folds."""
    v = [x for x in values if x is not None and math.isfinite(x)]
    mean = float(np.mean(v)) if v else float("nan")
    sd = float(np.std(v, ddof=1)) if len(v) > 1 else 0.0
    df = (n_folds if n_folds is not None else len(values)) - 1
    half = float(t_quantile(0.5 + ci / 2, df)) * sd / math.sqrt(len(v)) if df >= 1 and v else 0.0
    return {"mean": mean, "sd": sd, "low": mean - half, "high": mean + half}


def nadeau_bengio(values: list[float], test_share: float = 0.2, ci: float = 0.95) -> dict[str, float]:
    """The same with the variance corrected for folds that share training rows."""
    k, mean = len(values), float(np.mean(values)) if values else float("nan")
    if k < 2:
        return {"mean": mean, "low": mean, "high": mean}
    variance = float(np.var(values, ddof=1)) * (1 / k + test_share / (1 - test_share))
    half = float(t_quantile(0.5 + ci / 2, k - 1)) * math.sqrt(variance)
    return {"mean": mean, "low": mean - half, "high": mean + half}


def summarise_folds(folds: DataFrame, fold: str, keys: list[str]) -> DataFrame:
    """(metric, mean, sd, low, high, nb_low, nb_high) of the scores of a few folds.

    The mean and deviation are aggregated; the t quantile for the number of folds is a literal.
    """
    n = folds.select(fold).distinct().count()
    t = float(t_quantile(0.975, n - 1)) if n > 1 else 0.0
    long = folds.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.col(k).cast("double") for k in keys)))).alias("metric", "v"))
    per = long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("metric").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"), F.count("*").alias("k"))
    half = t * F.col("sd") / F.sqrt("k")
    share = 1.0 / max(n, 2)
    wide = t * F.col("sd") * F.sqrt(1 / F.col("k") + share / (1 - share))
    return per.select("metric", _r(F.col("mean")).alias("mean"), _r(F.col("sd")).alias("sd"), *(_r(x).alias(name) for name, x in (("low", F.col("mean") - half), ("high", F.col("mean") + half), ("nb_low", F.col("mean") - wide), ("nb_high", F.col("mean") + wide))))
