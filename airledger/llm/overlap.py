"""Same or nearly same records on both sides of a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.duplicates import near_values


def canonical_hash(kind: str, value: Column) -> Column:
    """128-bit hash of a value's text after case, punctuation and white space are taken out; null stays
    null. The sign of a number is no punctuation: -7 and 7 differ."""
    text = F.regexp_replace(F.lower(value.cast("string")), r"(?!^\s*-[0-9])[\p{P}\s]", "")
    return F.when(value.isNotNull(), F.struct(F.xxhash64(F.lit(kind), text).alias("h1"), F.xxhash64(text, F.lit(kind), F.lit(7)).alias("h2")))


def _keys(records: DataFrame) -> DataFrame:
    """(row, kind, h1, h2) of each record's image and group."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), canonical_hash(k, F.col(k)).alias("hash")) for k in ("image_id", "dup_group")))
    return records.select("row", F.explode(kinds).alias("k")).where(F.col("k.hash").isNotNull()).select("row", F.col("k.kind").alias("kind"), F.col("k.hash.h1").alias("h1"), F.col("k.hash.h2").alias("h2"))


def _near(train: DataFrame, evaluation: DataFrame, distance: int) -> DataFrame:
    """Fingerprints (eval_print, train_print) of the two sides that are near each other."""
    prints = lambda df: df.where(F.col("phash").isNotNull()).select(F.col("phash").alias("print")).distinct()
    return near_values(prints(evaluation), prints(train), distance).select(F.col("left_print").alias("eval_print"), F.col("right_print").alias("train_print"))


def cross_split_pairs(records: DataFrame, distance: int = 5) -> DataFrame:
    """(a, b): pairs of rows, smaller first, one in train and one in another split, that have the
    same image, the same group, or fingerprints within `distance` bits. Each pair once.

    `records` has row, split (train, cal, test or null), image_id, dup_group, phash. Rows with
    a null split are left out; null images, groups and fingerprints match nothing; a row that
    stands in both sides makes no pair with itself. Hashes of canonical evaluation records are
    joined with those of training records; fingerprints are compared as distinct values,
    their rows come in after that.
    """
    train, evaluation = records.where(F.col("split") == "train"), records.where(F.col("split").isin("cal", "test"))
    t, e = (_keys(x).select(F.col("row").alias(name), "h1", "h2") for x, name in ((train, "train_row"), (evaluation, "eval_row")))
    same = e.join(t, ["h1", "h2"]).select("train_row", "eval_row")
    near = (
        _near(train, evaluation, distance)
        .join(evaluation.select(F.col("row").alias("eval_row"), F.col("phash").alias("eval_print")), "eval_print")
        .join(train.select(F.col("row").alias("train_row"), F.col("phash").alias("train_print")), "train_print")
        .select("train_row", "eval_row")
    )
    pairs = same.unionByName(near).where(F.col("train_row") != F.col("eval_row"))
    return pairs.select(F.least("train_row", "eval_row").alias("a"), F.greatest("train_row", "eval_row").alias("b")).distinct()


def overlap_counts(records: DataFrame, distance: int = 5) -> DataFrame:
    """(split, station_no, photos, same_image, same_group, near_print, overlapping): evaluation
    rows per split and source, and how many of them occur in train in each way.

    Every row is counted by whether a match exists, so no pairs are written out.
    """
    train, evaluation = records.where(F.col("split") == "train"), records.where(F.col("split").isin("cal", "test"))
    there = _keys(train).select("h1", "h2").distinct()
    hits = _keys(evaluation).join(there, ["h1", "h2"], "left_semi").select("row", "kind")
    prints = _near(train, evaluation, distance).select(F.col("eval_print").alias("phash")).distinct()
    near = evaluation.join(prints, "phash", "left_semi").select("row", F.lit("phash").alias("kind"))
    marks = hits.unionByName(near).groupBy("row").agg(*(F.max(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"is_{k}") for k in ("image_id", "dup_group", "phash")))
    flagged = evaluation.join(marks, "row", "left")
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return flagged.groupBy("split", "station_no").agg(
        F.count("*").alias("photos"),
        one("is_image_id").alias("same_image"),
        one("is_dup_group").alias("same_group"),
        one("is_phash").alias("near_print"),
        F.count("is_phash").alias("overlapping"),
    )
