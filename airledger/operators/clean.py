"""Pooling, cleaning, de-duplicating, shuffling and sampling of observation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import md5_key, with_row_number

#: Columns that carry nothing.
DEAD = ("camera_angle", "quality_score", "downloaded_at", "filename", "quality")


def pooled(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts as one table, each row with the name of its part as `orig_split`."""
    named = [df.withColumn("orig_split", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def metadata(df: DataFrame) -> DataFrame:
    """Everything but the picture, which a columnar scan then never reads."""
    return df.drop("image")


def drop_dead(df: DataFrame) -> DataFrame:
    return df.drop(*DEAD)


def keep_first(df: DataFrame, key: str = "image_id", order: str = "_row") -> DataFrame:
    """The first row by `order` (unique) of each `key`; null keys are one group.

    The lowest `order` of each key comes from a partial aggregate, so a key with many copies
    isn't brought into one task.
    """
    first = df.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def duplicates_removed(df: DataFrame, key: str = "image_id") -> DataFrame:
    """One row: how many rows `keep_first` drops."""
    keys = F.count_distinct(key) + F.max(F.when(F.col(key).isNull(), 1).otherwise(0))
    return df.agg((F.count("*") - F.coalesce(keys, F.lit(0))).alias("n_duplicates_removed"))


def shuffled(df: DataFrame, key: str = "_row", seed: int = 42) -> DataFrame:
    """`df` with `position` (from 0) in a fixed random order of `key`."""
    return with_row_number(df.withColumn("__md5", md5_key(F.col(key), seed=seed)), [F.col("__md5"), F.col(key)], "position").withColumn("position", F.col("position") - 1).drop("__md5")


def exact_sample(df: DataFrame, n: int, key: str = "_row", seed: int = 42) -> DataFrame:
    """Exactly `n` rows (all if there are fewer), the first of the fixed random order.

    A top-n, which every task cuts down to its own first n rows.
    """
    return df.withColumn("__md5", md5_key(F.col(key), seed=seed)).orderBy("__md5", key).limit(n).drop("__md5")


def clean(df: DataFrame, seed: int = 42) -> DataFrame:
    """Dead columns dropped, first row of each image, positions of the shuffle."""
    return shuffled(keep_first(drop_dead(metadata(df))), seed=seed)


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """One row: the number of rows of `df` that break each rule (a condition that must hold)."""
    return df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
