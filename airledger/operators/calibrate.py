"""Conformal intervals, isotonic recalibration, back-transforms of model outputs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_between
from .ranks import order_statistic, with_last_before, with_row_number


def conformal_score(y: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - y, y - high)


def conformal_rank(n: Column, coverage: float = 0.9) -> Column:
    """1-based rank of the score that widens the interval: one past ceil((n + 1) * coverage), at most n."""
    k = F.ceil((n + 1) * F.lit(coverage))
    return F.least(k + 1, n)


def conformal_q(cal: DataFrame, y: str, low: str, high: str, coverage: float = 0.9) -> DataFrame:
    """One row (n, q): how far intervals must widen to hold `coverage` of new labels. No row for an empty table."""
    scored = cal.select(conformal_score(F.col(y), F.col(low), F.col(high)).alias("q"))
    return order_statistic(scored, "q", conformal_rank(F.col("n"), coverage))


def widen(df: DataFrame, q: DataFrame, low: str, high: str) -> DataFrame:
    """`df` with the interval widened by q, its lower end at least 0. `q` is one row, or none where
    there was nothing to calibrate with: then both ends are unknown (null), and no row is lost."""
    one = q.agg(F.max("q").alias("__q"))
    out = df.join(F.broadcast(one), how="cross")  # one row, also of an empty table
    known = F.col("__q").isNotNull()
    return out.withColumns({low: F.when(known, F.greatest(F.col(low) - F.col("__q"), F.lit(0.0))), high: F.col(high) + F.col("__q")}).drop("__q")


def _pooled(frame: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring violators of one range pooled: what is left rises strictly."""
    frame = frame.sort_values("low")
    out: list[list[float]] = []
    for low, high, v, w in zip(*(frame[c].to_numpy() for c in ("low", "high", "v", "w"))):
        out.append([low, high, v, w])
        while len(out) > 1 and out[-2][2] >= out[-1][2]:
            _, high2, v2, w2 = out.pop()
            low1, _, v1, w1 = out[-1]
            out[-1] = [low1, high2, (v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2]
    return pd.DataFrame(out, columns=["low", "high", "v", "w"])


def isotonic_fit(cal: DataFrame, x: str, y: str, block: int = 4096) -> DataFrame:
    """(x, fitted): knots of the nondecreasing least-squares fit of y on x, at least 0.

    Rows of equal x are averaged with their weight first. Adjacent violators are pooled in
    ranges of `block` neighbours, again and again with the ranges shifted by half, until one
    range holds all that is left or neither way of cutting leaves anything to pool: then no
    two neighbours violate the order, and pooling in any order gives the one fit. No task
    sees more than a range. Rows with a null in x or y don't count; none give no knots.
    """
    means = cal.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("low")).agg(F.avg(y).alias("v"), F.count("*").cast("double").alias("w"))
    left = means.select("low", F.col("low").alias("high"), "v", "w")
    n, quiet, shift = None, 0, 0
    while quiet < 2:
        ranked = with_row_number(left, [F.col("low")], "rank").withColumn("part", F.floor((F.col("rank") - 1 + shift) / block))
        left = write_between(ranked.groupBy("part").applyInPandas(_pooled, "low double, high double, v double, w double"), "pools")
        before, n = n, left.count()
        if not shift and (before or 0) <= block and ranked.agg(F.max("part")).first()[0] in (0, None):
            break
        quiet = quiet + 1 if n == before else 0
        shift = block // 2 - shift
    ends = F.when(F.col("high") > F.col("low"), F.array("low", "high")).otherwise(F.array("low"))
    return left.select(F.explode(ends).alias("x"), F.greatest("v", F.lit(0.0)).alias("fitted"))


def apply_fit(df: DataFrame, fit: DataFrame, point: str, out: str) -> DataFrame:
    """`df` with `out`: `point` read off the knots of `fit` (x, fitted) on straight lines, level beyond
    the ends, at least 0; null for null and NaN, and where there are no knots.

    Points find their knots along one order, cut into ranges, so neither side has to fit into
    one place.
    """
    fit = write_between(fit, "knots")
    numbered = with_row_number(fit, [F.col("x"), F.col("fitted")], "k")
    after = numbered.select((F.col("k") - 1).alias("k"), F.col("x").alias("x2"), F.col("fitted").alias("f2"))
    marks = numbered.join(after, "k", "left").select("x", F.struct(F.col("x").alias("x1"), F.col("fitted").alias("f1"), "x2", "f2").alias("__knot"))
    known = F.col(point).isNotNull() & ~F.isnan(F.col(point).cast("double"))
    rows = with_last_before(df.where(known).withColumn("__p", F.col(point).cast("double")), marks.withColumnRenamed("x", "__p"), "__p", "__knot")
    lowest = fit.agg(F.min_by("fitted", "x").alias("__lowest"))
    k = lambda name: F.col(f"__knot.{name}")
    line = F.when(k("x2").isNull(), k("f1")).otherwise(k("f1") + (F.col("__p") - k("x1")) * (k("f2") - k("f1")) / (k("x2") - k("x1")))
    read = F.when(F.col("__knot").isNull(), F.col("__lowest")).otherwise(line)
    given = rows.join(F.broadcast(lowest), how="cross").withColumn(out, F.when(read.isNotNull(), F.greatest(read, F.lit(0.0)))).drop("__p", "__knot", "__lowest")  # one row
    return given.unionByName(df.where(~F.coalesce(known, F.lit(False))).withColumn(out, F.lit(None).cast("double")))


def apply_knots(point: Column, xs: list[float], ys: list[float]) -> Column:
    """Straight lines between knots, level beyond the ends, at least 0; null for null and NaN, and
    where there are no knots.

    Arrow batches and a search in the sorted knots: a chain of conditions would grow with
    their number.
    """

    @F.arrow_udf("double")
    def read(point: pa.Array) -> pa.Array:
        x = point.to_numpy(zero_copy_only=False)
        none = np.isnan(x) if xs else np.ones(len(x), dtype=bool)
        y = np.maximum(np.interp(x, xs, ys), 0.0) if xs else np.zeros(len(x))
        return pa.array(y, pa.float64(), mask=none)

    return read(point.cast("double"))


def knots(fit: DataFrame) -> tuple[list[float], list[float]]:
    """The fitted knots on the driver, to be kept with a model. Large fits are applied by `apply_fit`."""
    rows = fit.orderBy("x").collect()
    return [r["x"] for r in rows], [r["fitted"] for r in rows]


def point_to_aqi(z: Column, mean: Column, std: Column) -> Column:
    return F.greatest(z * std + mean, F.lit(0.0))


def target_stats(df: DataFrame, y: str) -> DataFrame:
    """One row (y_mean, y_std), the deviation kept off zero."""
    return df.agg(F.avg(y).alias("y_mean"), (F.stddev_pop(y) + 1e-6).alias("y_std"))


def monotone_quantiles(base: Column, steps: list[Column]) -> list[Column]:
    """base, base + softplus(s1), base + softplus(s1) + softplus(s2), ...: never falling."""
    out = [base]
    for s in steps:
        out.append(out[-1] + F.greatest(s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s))))
    return out


def ensemble_mean(members: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean over members in log space, then back: one row per key."""
    return members.groupBy(key).agg(*(F.exp(F.avg(F.log(c))).alias(c) for c in columns))


def averaged_outputs(outputs: DataFrame, keys: list[str], logs: list[str], plain: list[str]) -> DataFrame:
    """One row per `keys` of the outputs of several members, or of a picture and its mirror image: quantiles
    (`logs`) are averaged as logarithms, points (`plain`) as they are."""
    return outputs.groupBy(*keys).agg(*(F.exp(F.avg(F.log(c))).alias(c) for c in logs), *(F.avg(c).alias(c) for c in plain))


def cosine_warmup(epoch: Column, warmup: int, most: int) -> Column:
    """Learning-rate factor: a straight rise, then half a cosine down to 0."""
    share = (epoch - warmup) / float(max(1, most - warmup))
    return F.when(epoch < warmup, (epoch + 1) / float(max(1, warmup))).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * F.least(share, F.lit(1.0)))))
