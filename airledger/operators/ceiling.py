"""How much of a score label noise allows: within-day variance of hourly readings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aqi import BAND_EDGES, band, band_label, pm25_to_aqi
from .ranks import percentiles_by_key

#: Fixed value: the normal quantile of a central 90 % interval.
Z90 = 1.6448536269514722


def clean_hourly(df: DataFrame, station: str = "location_id", time: str = "datetime", value: str = "pm25_ugm3", convention: int = 2012, most: float = 1000.0) -> DataFrame:
    """(station, day, aqi) of the readings that count: a finite concentration in [0, most], a
    readable time, an index. Null stations are left out."""
    x = F.col(value).try_cast("double")
    day = F.to_date(F.try_to_timestamp(F.col(time)))
    rows = df.select(F.col(station).alias("station"), day.alias("day"), x.alias("c")).where(F.col("station").isNotNull() & F.col("day").isNotNull() & (F.col("c") >= 0) & (F.col("c") <= most))
    return rows.select("station", "day", pm25_to_aqi(F.col("c"), convention).alias("aqi"))


def per_day(clean: DataFrame, min_hours: int = 18) -> DataFrame:
    """(station, day, n_hours, day_mean_aqi, within_day_var) of the days with enough rows."""
    days = clean.groupBy("station", "day").agg(F.count("*").alias("n_hours"), F.avg("aqi").alias("day_mean_aqi"), F.var_samp("aqi").alias("within_day_var"))
    return days.where(F.col("n_hours") >= min_hours)


def deviations(clean: DataFrame, min_hours: int = 18) -> DataFrame:
    """(station, day, deviation): each reading less the mean of its day, for days with enough rows.

    The means come from a partial aggregate and are joined back, so a busy day isn't sorted in one task.
    """
    return clean.join(per_day(clean, min_hours), ["station", "day"]).select("station", "day", (F.col("aqi") - F.col("day_mean_aqi")).alias("deviation"))


def noise_curve(days: DataFrame) -> DataFrame:
    """(band_idx, band, n_days, v, rmse_within_day): mean within-day variance by level; bands without days are left out."""
    by = days.where(F.col("within_day_var").isNotNull()).groupBy(band(F.col("day_mean_aqi")).alias("band_idx"))
    return by.agg(F.count("*").alias("n_days"), F.avg("within_day_var").alias("v")).select("band_idx", band_label(F.col("band_idx")).alias("band"), "n_days", "v", F.sqrt("v").alias("rmse_within_day"))


def label_hist(labels: DataFrame, label: str) -> DataFrame:
    """(band_idx, p): share of labels in each of the six bands, zero where there are none; null and
    infinite labels don't count."""
    y = F.col(label)
    fine = labels.where(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    one = fine.agg(F.count("*").alias("n"), *(F.count_if(band(y) == i).alias(f"b{i}") for i in range(len(BAND_EDGES) + 1)))
    pairs = F.array(*(F.struct(F.lit(i).alias("band_idx"), F.try_divide(F.col(f"b{i}").cast("double"), F.col("n")).alias("p")) for i in range(len(BAND_EDGES) + 1)))
    return one.select(F.explode(pairs).alias("x")).select("x.band_idx", "x.p")


def imputed_curve(curve: DataFrame, hist: DataFrame) -> DataFrame:
    """(band_idx, p, v, covered): bands without days get the largest v seen, bands above the top
    one go on along the rising least-squares slope."""
    fit = curve.agg(
        F.greatest(F.coalesce(F.when(F.count("*") > 1, F.regr_slope("v", "band_idx")), F.lit(0.0)), F.lit(0.0)).alias("slope"),
        F.max("v").alias("v_max"), F.max("band_idx").alias("top"), F.max_by("v", "band_idx").alias("top_v"),
    )
    both = hist.join(curve.select("band_idx", "v"), "band_idx", "left").join(F.broadcast(fit), how="cross")  # six rows, one row
    guess = F.when(F.col("band_idx") > F.col("top"), F.greatest(F.col("v_max"), F.col("top_v") + F.col("slope") * (F.col("band_idx") - F.col("top")))).otherwise(F.col("v_max"))
    return both.select("band_idx", "p", F.coalesce("v", guess).alias("v"), F.col("v").isNotNull().alias("covered"))


def reweighted_variance(curve: DataFrame, hist: DataFrame, impute: bool = False) -> DataFrame:
    """One row (var_epsilon, p_covered): noise variance at the levels that the labels have."""
    full = imputed_curve(curve, hist).where(F.col("p") > 0)
    use = full if impute else full.where("covered")
    covered = full.agg(F.coalesce(F.sum(F.when(F.col("covered"), F.col("p"))), F.lit(0.0)).alias("p_covered"))
    return use.agg(F.try_divide(F.sum(F.col("p") * F.col("v")), F.sum("p")).alias("var_epsilon")).join(F.broadcast(covered), how="cross")  # one row each


def r2_max(var_epsilon: Column, var_labels: Column) -> Column:
    """1 less the noise share, within [0, 1]; null where the labels don't vary."""
    raw = 1 - F.try_divide(var_epsilon, F.when(var_labels > 0, var_labels))
    return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def interval_floor(devs: DataFrame, coverage: float = 0.9) -> DataFrame:
    """One row (floor): width of the central part of the deviations; null if there are none."""
    tail = (1 - coverage) / 2
    ends = percentiles_by_key(devs, [], "deviation", {"low": tail, "high": 1 - tail})
    return ends.select((F.col("high") - F.col("low")).alias("floor"))


def error_ceiling(clean: DataFrame, labels: DataFrame, label: str, min_hours: int = 18) -> DataFrame:
    """One row: noise variance (as covered and imputed), label variance, the highest r2 each allows,
    noise share, interval floor (measured, and for normal noise), share of labels covered."""
    days = per_day(clean, min_hours)
    curve, hist = noise_curve(days), label_hist(labels, label)
    low = reweighted_variance(curve, hist).select("var_epsilon", "p_covered")
    high = reweighted_variance(curve, hist, impute=True).select(F.col("var_epsilon").alias("var_conservative"))
    y = F.col(label)
    var = labels.where(y.isNotNull() & ~F.isnan(y)).agg(F.var_pop(label).alias("var_labels"))
    one = low.join(F.broadcast(high), how="cross").join(F.broadcast(var), how="cross").join(F.broadcast(interval_floor(deviations(clean, min_hours))), how="cross")  # one row each
    return one.select(
        "var_epsilon", "var_conservative", "var_labels",
        r2_max(F.col("var_epsilon"), F.col("var_labels")).alias("r2_max"),
        r2_max(F.col("var_conservative"), F.col("var_labels")).alias("r2_max_conservative"),
        F.try_divide("var_epsilon", "var_labels").alias("noise_fraction"),
        F.col("floor").alias("interval_floor"), (2 * Z90 * F.sqrt("var_epsilon")).alias("interval_floor_normal"),
        "p_covered", (F.col("p_covered") < 0.98).alias("optimistic"),
    )


def require_days(days: DataFrame) -> DataFrame:
    """`days`, or an error where no station has a day with enough hours."""
    if days.isEmpty():
        raise ValueError("no station-days with enough hours")
    return days


def per_split_r2max(splits: DataFrame, split: str, label: str, var_epsilon: DataFrame) -> DataFrame:
    """(split, var_labels, r2_max) for splits whose labels vary."""
    per = splits.where(F.col(split).isNotNull()).groupBy(split).agg(F.var_pop(label).alias("var_labels")).where(F.col("var_labels") > 0)
    return per.join(F.broadcast(var_epsilon.select("var_epsilon")), how="cross").select(split, "var_labels", r2_max(F.col("var_epsilon"), F.col("var_labels")).alias("r2_max"))  # one row


def bootstrap_r2max(days: DataFrame, hist: DataFrame, var_labels: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """One row (n_boot, median, low, high) of r2_max with stations drawn anew.

    Instead of drawing S of S stations, each draw gives every station a count from the
    distribution that such drawing has in the limit (Poisson with mean 1), read off a hash of
    station, draw and seed. Station-days are brought down to (station, band) sums first; all
    draws are one aggregate, each station exploded into the draws in which it stands.
    """
    cells = days.groupBy("station", band(F.col("day_mean_aqi")).alias("band_idx")).agg(F.sum("within_day_var").alias("s"), F.count("within_day_var").alias("n"))
    text = F.concat_ws("#", F.col("station").cast("string"), F.col("b").cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)
    count = None
    for k, top in enumerate(poisson_steps()):
        count = F.when(u < top, k) if count is None else count.when(u < top, k)
    drawn = cells.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("times", count.otherwise(len(poisson_steps()))).where("times > 0")
    per = drawn.groupBy("b", "band_idx").agg(F.try_divide(F.sum(F.col("s") * F.col("times")), F.sum(F.col("n") * F.col("times"))).alias("v"))
    eps = per.join(F.broadcast(hist), "band_idx").where((F.col("p") > 0) & F.col("v").isNotNull()).groupBy("b").agg(F.try_divide(F.sum(F.col("p") * F.col("v")), F.sum("p")).alias("var_epsilon"))  # six rows
    r2 = eps.join(F.broadcast(var_labels), how="cross").select(r2_max(F.col("var_epsilon"), F.col("var_labels")).alias("r2"))  # one row
    return r2.where(F.col("r2").isNotNull()).agg(F.count("*").alias("n_boot"), F.percentile("r2", 0.5).alias("median"), F.percentile("r2", 0.025).alias("low"), F.percentile("r2", 0.975).alias("high"))


def poisson_steps(most: int = 8) -> list[float]:
    """Distribution function of a Poisson count with mean 1, up to `most`."""
    out, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return out


