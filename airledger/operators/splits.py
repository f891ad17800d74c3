"""Train, calibration and test splits, leaky and safe, and grouped folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_between
from .ranks import md5_key, with_last_before, with_row_number, with_running_sum
from .shares import fill_shares, numbered, placed, plan_parts, size_histogram, targets

#: The splits, in the order that breaks ties, with the usual shares.
SHARES = {"train": 0.65, "cal": 0.15, "test": 0.20}


def _cut(rank: Column, n: int, shares: dict[str, float]) -> Column:
    """Split of the rank-th of n rows: sizes rounded half to even, the last split takes the rest."""
    names = list(shares)
    first, second = round(shares[names[0]] * n), round(shares[names[1]] * n)
    return F.when(rank <= first, names[0]).when(rank <= first + second, names[1]).otherwise(names[2])


def random_split(df: DataFrame, key: str = "_row", shares: dict[str, float] = SHARES, seed: int = 42) -> DataFrame:
    """Rows in a fixed random order, cut by count; it ignores sources and so leaks."""
    df = df.withColumn("__md5", md5_key(F.col(key), seed=seed))
    ranked = with_row_number(df, [F.col("__md5"), F.col(key)], "__rank")
    return ranked.withColumn("split", _cut(F.col("__rank"), ranked.count(), shares)).drop("__md5", "__rank")


def temporal_split(df: DataFrame, time: str = "captured_at", key: str = "_row", shares: dict[str, float] = SHARES) -> DataFrame:
    """Rows in the order of their time (then key), cut by count. Null times are left out."""
    df = df.withColumn("__t", F.try_to_timestamp(F.col(time))).where(F.col("__t").isNotNull())
    ranked = with_row_number(df, [F.col("__t"), F.col(key)], "__rank")
    return ranked.withColumn("split", _cut(F.col("__rank"), ranked.count(), shares)).drop("__t", "__rank")


def grouped_split(df: DataFrame, group: Column, shares: dict[str, float] = SHARES, seed: int = 42) -> DataFrame:
    """Whole groups to splits: the largest first, each to the split that then lacks most rows. Rows with a null group are left out."""
    df = df.withColumn("__group", group.cast("string")).where(F.col("__group").isNotNull())
    sizes = df.groupBy(F.col("__group").alias("component")).agg(F.count("*").alias("n"))
    placed = fill_shares(sizes, shares, seed=seed).select(F.col("component").alias("__group"), "split")
    return df.join(placed, "__group").drop("__group")


def station_split(df: DataFrame, station: str = "station_id", shares: dict[str, float] = SHARES, seed: int = 42) -> DataFrame:
    return grouped_split(df, F.col(station), shares, seed)


def geo_cell(lat: Column, lon: Column, degrees: int = 10) -> Column:
    """Name of the cell of `degrees` by `degrees` that holds a place."""
    side = lambda x: (F.floor(x / degrees) * degrees).cast("int").cast("string")
    return F.concat(side(lat), F.lit("_"), side(lon))


def geographic_split(df: DataFrame, lat: str = "latitude", lon: str = "longitude", degrees: int = 10, shares: dict[str, float] = SHARES, seed: int = 42) -> DataFrame:
    return grouped_split(df, geo_cell(F.col(lat), F.col(lon), degrees), shares, seed)


def shipped_split(df: DataFrame, station: str = "station_id", shares: dict[str, float] = SHARES, seed: int = 42) -> DataFrame:
    """Rows that came as test stay test; a part of the other stations becomes cal, the rest train."""
    test = df.where(F.col("orig_split") == "test").withColumn("split", F.lit("test"))
    rest = df.where(~F.col("orig_split").eqNullSafe("test"))
    whole = shares["train"] + shares["cal"]
    return grouped_split(rest, F.col(station), {"train": shares["train"] / whole, "cal": shares["cal"] / whole}, seed).unionByName(test)


def split_report(df: DataFrame, station: str = "station_id") -> DataFrame:
    """One row: rows, rounded share and stations of each split, and stations in more than one.

    Rows are brought down to (station, split) first, so nothing counts distinct values of rows.
    """
    cells = df.groupBy(station, "split").agg(F.count("*").alias("n"))
    is_ = lambda s: F.col("split") == s
    per = cells.groupBy(station).agg(
        *(F.coalesce(F.sum(F.when(is_(s), F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in SHARES),
        *(F.max(F.when(is_(s) & F.col(station).isNotNull(), 1).otherwise(0)).alias(f"in_{s}") for s in SHARES),
    )
    total = sum((F.sum(f"n_{s}") for s in SHARES), F.lit(0))
    spread = sum((F.col(f"in_{s}") for s in SHARES), F.lit(0))
    return per.agg(
        *(F.sum(f"n_{s}").alias(f"n_{s}") for s in SHARES),
        *(F.round(F.try_divide(F.sum(f"n_{s}"), total), 3).alias(f"frac_{s}") for s in SHARES),
        *(F.sum(f"in_{s}").alias(f"stations_{s}") for s in SHARES),
        F.count_if(spread > 1).alias("straddling"),
    )


def straddling(df: DataFrame, station: str = "station_id") -> DataFrame:
    """(station, n_splits): stations that stand in more than one split."""
    per = df.where(F.col(station).isNotNull() & F.col("split").isNotNull()).select(station, "split").distinct().groupBy(station).agg(F.count("*").alias("n_splits"))
    return per.where("n_splits > 1")


def cv_folds(df: DataFrame, folds: int = 5, cal_share: float = 0.1875, station: str = "station_id", seed: int = 42) -> DataFrame:
    """(station, n, fold, role) with every station in every fold: test once, else cal or train.

    Stations go to test folds of equal shares, the largest first to the fold that then holds
    least; of the others in a fold, a part of `cal_share` becomes cal in the same way. Only
    the table of station sizes is handled, and the driver plans all folds from the number of
    stations of each size. Rows without a station are left out.
    """
    sizes = df.where(F.col(station).isNotNull()).groupBy(F.col(station).cast("string").alias("component")).agg(F.count("*").alias("n"))
    sizes = write_between(sizes, "stations")
    histogram = size_histogram(sizes)
    total = sum(n * c for n, c in histogram.items())
    names = [str(k) for k in range(folds)]
    plan = plan_parts(histogram, targets(dict.fromkeys(names, 1 / folds), total))
    dealt = placed(numbered(sizes, seed), plan, names, "fold")
    dealt = write_between(dealt.withColumn("fold", F.col("fold").cast("int")), "folds")
    out = dealt.select(F.col("component").alias(station), "n", "fold", F.lit("test").alias("role"))
    for k in range(folds):
        others = {n: c - plan[n][k] for n, c in histogram.items() if c > plan[n][k]}
        parts = plan_parts(others, targets({"train": 1 - cal_share, "cal": cal_share}, sum(n * c for n, c in others.items())))
        roles = placed(numbered(dealt.where(F.col("fold") != k), seed + k), parts, ["train", "cal"], "role")
        out = out.unionByName(roles.select(F.col("component").alias(station), "n", F.lit(k).alias("fold"), "role"))
    return out.select("fold", station, "n", "role")


def balanced_weights(df: DataFrame, label_band: Column, power: float = 0.5) -> DataFrame:
    """`df` with `weight`: (1 / rows of the row's band) ** power. The bands are a small fixed set."""
    counts = df.groupBy(label_band.alias("__band")).agg(F.count("*").alias("__n"))
    joined = df.withColumn("__row_band", label_band).join(counts, F.col("__row_band").eqNullSafe(F.col("__band")), "left")
    return joined.withColumn("weight", F.pow(1.0 / F.greatest(F.col("__n"), F.lit(1)), F.lit(power))).drop("__band", "__row_band", "__n")


def half_split(df: DataFrame, station: str = "station_id", seed: int = 42) -> DataFrame:
    """(station, part): stations in a fixed random order, the first half `fit`, the others `eval`."""
    stations = df.where(F.col(station).isNotNull()).select(station).distinct().withColumn("__md5", md5_key(F.col(station), seed=seed))
    ranked = with_row_number(stations, [F.col("__md5"), F.col(station)], "__rank")
    n = ranked.count()
    return ranked.select(station, F.when(F.col("__rank") <= n // 2, "fit").otherwise("eval").alias("part"))


def weighted_sample(df: DataFrame, weight: str, n: int, key: str = "_row", seed: int = 42) -> DataFrame:
    """(draw, key): `n` draws with replacement, each row in proportion to its weight.

    Draw i falls at a fixed random point of the running sum of weights, and takes the row whose
    share of the sum begins last before it. Rows without a positive weight are never drawn.
    """
    rows = df.where(F.col(weight) > 0).select(F.col(key).alias("key"), F.col(weight).alias("w"))
    run = with_running_sum(rows, [F.col("key")], F.col("w"), "upto")
    total = run.agg(F.max("upto")).first()[0] or 0.0
    at = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"#{seed}"))), 1, 12), 16, 10).cast("double") / float(16**12) * total
    draws = df.sparkSession.range(n if total else 0).select(F.col("id").alias("draw"), at.alias("at"))
    marks = run.select((F.col("upto") - F.col("w")).alias("at"), "key")
    return with_last_before(draws, marks, "at", "key").select("draw", F.col("key").alias(key))
