"""When not to answer: out-of-distribution scores, thresholds, the gate, risk against coverage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import order_statistic, percentiles_by_key, with_average_rank, with_row_number, with_running_sum


def log_width(low: Column, high: Column) -> Column:
    return F.log(high) - F.log(low)


def ood_threshold(scores: DataFrame, score: str, budget: float = 0.05) -> DataFrame:
    """One row (n, tau): at most `budget` of good scores lie above tau; infinite for an empty table, so
    that nothing is refused."""
    k = F.floor(F.lit(budget) * F.col("n"))
    rank = F.when(k <= 0, F.col("n")).otherwise(F.col("n") - k)
    one = order_statistic(scores.select(F.col(score).alias("tau")), "tau", rank)
    return one.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("tau"), F.lit(float("inf"))).alias("tau"))


def width_threshold(widths: DataFrame, width: str, coverage: float = 0.9) -> DataFrame:
    """One row (tau): the linear percentile of the widths; null if there are none."""
    return percentiles_by_key(widths, [], width, {"tau": coverage}).select("tau")


def decide(score: Column, width: Column, tau_score: Column, tau_width: Column, why: Column) -> Column:
    """struct(answer, reason): the score is judged before the width; only above tau is refused."""
    refuse = lambda reason: F.struct(F.lit(False).alias("answer"), reason.alias("reason"))
    return F.when(score > tau_score, refuse(why)).when(width > tau_width, refuse(F.lit("interval too wide"))).otherwise(F.struct(F.lit(True).alias("answer"), F.lit("ok").alias("reason")))


def refuse_rate(score: Column, tau: Column) -> Column:
    return F.avg(F.when(score > tau, 1.0).otherwise(0.0))


def risk_coverage(df: DataFrame, uncertainty: str, error: str, key: str) -> DataFrame:
    """(key, rank, coverage, risk): mean error of the rows up to each, the surest first; ties by key."""
    fine = df.where(F.col(uncertainty).isNotNull() & F.col(error).isNotNull()).select(F.col(key).alias("key"), F.col(uncertainty).alias("u"), F.col(error).alias("e"))
    run = with_running_sum(fine, [F.col("u"), F.col("key")], F.col("e"), "sum_e")
    n = fine.agg(F.count("*").alias("n"))
    return run.join(F.broadcast(n), how="cross").select(F.col("key").alias(key), "rank", (F.col("rank") / F.col("n")).alias("coverage"), (F.col("sum_e") / F.col("rank")).alias("risk"), "n")  # one row


def _area(curve: DataFrame, value: Column) -> DataFrame:
    """Trapezoids between successive ranks: ends count half, all others once."""
    end = F.when((F.col("rank") == 1) | (F.col("rank") == F.col("n")), 0.5).otherwise(1.0)
    return curve.agg(F.when(F.max("n") > 1, F.sum(value * end) / F.max("n")).otherwise(0.0).alias("area"))


def risk_areas(df: DataFrame, uncertainty: str, error: str, key: str) -> DataFrame:
    """One row (n, aurc, excess_aurc, augrc); the excess is over ordering by the error itself."""
    curve = risk_coverage(df, uncertainty, error, key)
    best = risk_coverage(df, error, error, key)
    a = _area(curve, F.col("risk")).select(F.col("area").alias("aurc"))
    g = _area(curve, F.col("risk") * F.col("coverage")).select(F.col("area").alias("augrc"))
    b = _area(best, F.col("risk")).select(F.col("area").alias("best"))
    n = curve.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(a), how="cross").join(F.broadcast(b), how="cross").join(F.broadcast(g), how="cross").select("n", "aurc", (F.col("aurc") - F.col("best")).alias("excess_aurc"), "augrc")  # one row each


def most_confident(df: DataFrame, uncertainty: str, key: str, coverage: float) -> DataFrame:
    """The surest rows: their number is `coverage` of all, rounded half to even, at least 1."""
    ranked = with_row_number(df.where(F.col(uncertainty).isNotNull()), [F.col(uncertainty), F.col(key)], "__rank")
    k = max(1, round(coverage * ranked.count()))
    return ranked.where(F.col("__rank") <= k).drop("__rank")


def ood_metrics(scores: DataFrame, score: str, is_ood: str) -> DataFrame:
    """One row (n_id, n_ood, auroc, aupr, fpr95) of scores that should be high where `is_ood`.

    auroc from average ranks; aupr as average precision over distinct scores; fpr95 is the
    share of in-distribution scores at or above the 5th percentile of the others.
    """
    rows = scores.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(is_ood).alias("o"))
    cut = percentiles_by_key(rows.where("o"), [], "s", {"cut": 0.05}).select("cut")
    sizes = rows.agg(F.count_if(~F.col("o")).alias("n_id"), F.count_if("o").alias("n_ood")).join(F.broadcast(cut), how="cross")  # one row each
    ranks = with_average_rank(rows, "s", "r").agg(F.sum(F.when(F.col("o"), F.col("r"))).alias("rank_sum"))
    levels = rows.groupBy("s").agg(F.count("*").alias("c"), F.count_if("o").alias("pos")).withColumn("down", -F.col("s"))
    run = with_running_sum(levels, [F.col("down")], F.col("c"), "seen")
    run = with_running_sum(run.drop("rank"), [F.col("down")], F.col("pos"), "hits")
    ap = run.agg(F.sum(F.col("pos") * F.col("hits") / F.col("seen")).alias("gain"))
    high = rows.join(F.broadcast(sizes), how="cross").agg(F.avg(F.when(~F.col("o"), F.when(F.col("s") >= F.col("cut"), 1.0).otherwise(0.0))).alias("fpr95"))
    one = sizes.join(F.broadcast(ranks), how="cross").join(F.broadcast(ap), how="cross").join(F.broadcast(high), how="cross")  # one row each
    return one.select(
        "n_id", "n_ood",
        F.try_divide(F.col("rank_sum") - F.col("n_ood") * (F.col("n_ood") + 1) / 2, F.col("n_ood") * F.col("n_id")).alias("auroc"),
        F.try_divide("gain", "n_ood").alias("aupr"), "fpr95",
    )


def ood_summary(scores: DataFrame, score: str, kind: str) -> DataFrame:
    """(subset, ...): `ood_metrics` of all foreign rows, and of the near and the far ones, against the
    familiar rows. `kind` is id, near or far; a subset without foreign rows has no row."""
    known = {r[0] for r in scores.select(kind).distinct().collect()}  # at most the three kinds
    out = None
    for name, kinds in (("all", ("near", "far")), ("near", ("near",)), ("far", ("far",))):
        if known & set(kinds):
            rows = scores.where(F.col(kind).isin("id", *kinds)).withColumn("__ood", F.col(kind) != "id")
            one = ood_metrics(rows, score, "__ood").select(F.lit(name).alias("subset"), "*")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else ood_metrics(scores.limit(0).withColumn("__ood", F.lit(True)), score, "__ood").select(F.lit("all").alias("subset"), "*").limit(0)


def station_shift(holdout: DataFrame, unseen: DataFrame, score: str, budget: float = 0.05) -> DataFrame:
    """One row (tau, holdout_rate, unseen_rate, excess): the threshold that `budget` of the held-out rows of
    known stations pass, how many of these and of unseen stations are refused by it, and the excess."""
    tau = ood_threshold(holdout, score, budget).select("tau")
    rate = lambda df, name: df.join(F.broadcast(tau), how="cross").agg(refuse_rate(F.col(score), F.col("tau")).alias(name))  # noqa: E731 - one row
    one = tau.join(F.broadcast(rate(holdout, "holdout_rate")), how="cross").join(F.broadcast(rate(unseen, "unseen_rate")), how="cross")  # one row each
    return one.withColumn("excess", F.col("unseen_rate") - F.col("holdout_rate"))


def knn_distance(queries: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 5, block: int = 256) -> DataFrame:
    """(key, distance): distance of each query to its k-th nearest reference row (the farthest, if
    there are fewer). A query that stands in the reference finds itself at 0.

    Queries are a stated set and go out in blocks of `block` vectors; every task keeps the k
    smallest distances of its own rows for each query of a block, so what is shuffled is k
    rows per query and task, never all pairs.
    """
    spark = queries.sparkSession
    kind = dict(queries.dtypes)[key]
    numbered = with_row_number(queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v")), [F.col("key")], "rank")
    blocks = math.ceil(numbered.count() / block)
    near = None
    for b in range(blocks):
        rows = numbered.where((F.col("rank") > b * block) & (F.col("rank") <= (b + 1) * block)).collect()  # at most `block` rows
        sent = spark.sparkContext.broadcast(([r["key"] for r in rows], np.array([r["v"] for r in rows], dtype=np.float64)))

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, q = sent.value
            best = np.full((len(keys), 0), 0.0)
            for batch in batches:
                column = batch.column(0)
                if not batch.num_rows:
                    continue
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0))
                best = np.concatenate([best, d], axis=1)
                if best.shape[1] > k:
                    best = np.partition(best, k - 1, axis=1)[:, :k]
            if best.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, best.shape[1])), pa.array(best.ravel())], names=["key", "distance"])

        one = reference.where(F.col(vector).isNotNull()).select(vector).mapInArrow(nearest, f"key {kind}, distance double")
        near = one if near is None else near.unionByName(one)
    if near is None:
        return numbered.select(F.col("key").alias(key), F.lit(None).cast("double").alias("distance")).limit(0)
    order = Window.partitionBy("key").orderBy("distance")
    kept = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return kept.groupBy("key").agg(F.max("distance").alias("distance")).withColumnRenamed("key", key)


def fit_mahalanobis(features: DataFrame, vector: str) -> dict[str, np.ndarray]:
    """mean and precision with Ledoit-Wolf shrinkage, from one pass of moments per task.

    Each task brings its rows down to sums of size D x D; the driver sees one such block per
    tree level, so its memory depends on D only.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss, q = 0, None, None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            if s is None:
                s, ss = np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], names=["n", "s", "ss"])

    rows = features.where(F.col(vector).isNotNull()).select(vector)

    def total(df: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
        sums = df.select(F.col("n"), F.posexplode(F.concat("s", "ss")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()  # D + D * D rows
        flat = np.array([r["x"] for r in sums])
        d = int((math.isqrt(1 + 4 * len(flat)) - 1) // 2)
        return sums[0]["n"] if sums else 0, flat[:d], flat[d:].reshape(d, d)

    n, s, ss = total(rows.mapInArrow(moments, "n double, s array<double>, ss array<double>"))
    if not n:
        raise ValueError("no features")
    mean = s / n
    cov = ss / n - np.outer(mean, mean)
    sent = features.sparkSession.sparkContext.broadcast(mean)

    def fourth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) - sent.value
                out += float(((x**2).sum(1) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([out])], names=["q"])

    q = rows.mapInArrow(fourth, "q double").agg(F.sum("q")).first()[0]
    d = len(mean)
    mu = np.trace(cov) / d
    spread = ((cov - mu * np.eye(d)) ** 2).sum() / d
    noise = min((q / n - (cov**2).sum()) / (n * d), spread)
    shrink = 0.0 if spread <= 0 else noise / spread
    return {"mean": mean, "precision": np.linalg.pinv((1 - shrink) * cov + shrink * mu * np.eye(d)), "shrinkage": np.array(shrink)}


def mahalanobis(vector: Column, fitted: dict[str, np.ndarray]) -> Column:
    mean, precision = fitted["mean"], fitted["precision"]

    @F.arrow_udf("double")
    def score(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) - mean
        return pa.array(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, precision, x), 0)))

    return score(vector)


def handcrafted_parts(brightness: Column, detail: Column) -> tuple[Column, Column]:
    """How dark and how flat a picture is, 0 to 1."""
    return F.greatest(F.lit(0.0), (0.25 - brightness) / 0.25), F.greatest(F.lit(0.0), (0.003 - detail) / 0.003)


def handcrafted_score(brightness: Column, detail: Column) -> Column:
    return F.greatest(*handcrafted_parts(brightness, detail))


def handcrafted_reason(brightness: Column, detail: Column) -> Column:
    dark, flat = handcrafted_parts(brightness, detail)
    return F.when(dark >= flat, "too dark").otherwise("too flat")
