"""Near-duplicates by 64-bit fingerprints: exact pairs, groups and a report."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_between
from .graph import connected_components

BITS = 64
#: Blocks that the bits of two fingerprints beyond `distance` are dealt to: two of them agree.
SPARE = 2
#: A bucket in which both sides have more values than this is divided by further bits.
FULL = 4096
#: One value in so many is counted to find full buckets. It steers the plan; no result depends on it.
COUNTED = 64


def block_masks(mask: int, distance: int) -> list[int]:
    """Masks that hold the bits of `mask` and more, such that any two fingerprints which agree under
    `mask` and are within `distance` agree under one of them.

    The bits left are dealt to distance + 2 blocks in turn, so that bits which hardly vary are
    spread over all of them; at most `distance` blocks differ, so two agree. None if too few
    bits are left to divide.
    """
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    left, blocks = [b for b in range(BITS) if not mask >> b & 1], distance + SPARE
    if len(left) < 2 * blocks:
        return []
    dealt = [sum(1 << b for b in left[k::blocks]) for k in range(blocks)]
    return [signed(mask % (1 << BITS) | sum(dealt[k] for k in chosen)) for chosen in combinations(range(blocks), SPARE)]


def near_values(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """(left_print, right_print): distinct fingerprints of the two sides (column `print`, distinct)
    that differ in at most `distance` bits.

    Exact, with the same masks for any number of fingerprints: two within the distance meet
    in a bucket under one of them. Where a bucket is full on both sides, its values are
    divided by the bits that its mask leaves, in the same way and as often as it takes, so
    the comparisons of a value stay bounded by FULL a bucket. What is shuffled is a
    fingerprint and a 32-bit key a mask; keys that coincide cost a comparison, no more.
    """
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # a task would else write all keys of many values, since the distinct values themselves are small
    fronts = [df.select("print", F.lit(0).cast("long").alias("mask")).repartition(parts) for df in (left, right)]
    parents, out = [0], None
    while parents:
        masks = {p: block_masks(p, distance) for p in parents}  # 21 a parent
        if len(masks) == 1:
            children = [df.select("print", F.explode(F.array(*(F.lit(m).cast("long") for m in masks[parents[0]]))).alias("child")) for df in fronts]
        else:
            table = spark.createDataFrame([(p, m) for p, ms in masks.items() for m in ms], "mask long, child long")
            children = [df.join(F.broadcast(table), "mask").select("print", "child") for df in fronts]
        under = F.hash("child", F.col("print").bitwiseAND(F.col("child")))
        a, b = (df.select("print", F.col("child").alias("mask"), under.alias("key")) for df in children)
        counted = [df.where(F.pmod(F.xxhash64("print"), F.lit(COUNTED)) == 0).groupBy("mask", "key").agg((F.count("*") * COUNTED).alias("n")).where(F.col("n") > FULL) for df in (a, b)]
        dividable = F.col("mask").isin([m for m in {m for ms in masks.values() for m in ms} if block_masks(m, distance)])
        full = write_between(counted[0].join(counted[1], ["mask", "key"]).where(dividable).select("mask", "key"), "full")
        parents = [r["mask"] for r in full.select("mask").distinct().collect()]  # at most 21 a level and parent
        if parents:
            fronts = [df.join(full, ["mask", "key"], "left_semi").select("print", "mask").distinct() for df in (a, b)]
            a, b = (df.join(full, ["mask", "key"], "left_anti") for df in (a, b))
        pairs = a.select("key", F.col("print").alias("left_print")).join(b.select("key", F.col("print").alias("right_print")), "key")
        pairs = pairs.where(F.bit_count(F.col("left_print").bitwiseXOR(F.col("right_print"))) <= distance).select("left_print", "right_print")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def near_pairs(df: DataFrame, fingerprint: str = "phash", distance: int = 5) -> DataFrame:
    """(print_a, print_b, distance): pairs of different fingerprints, smaller first, within
    `distance` bits. Copies of one fingerprint stand for one value; null ones match nothing."""
    values = df.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias("print")).distinct()
    near = near_values(values, values, distance).where("left_print < right_print")
    return near.select(F.col("left_print").alias("print_a"), F.col("right_print").alias("print_b"), F.bit_count(F.col("left_print").bitwiseXOR(F.col("right_print"))).alias("distance"))


def near_groups(df: DataFrame, row: str = "_row", fingerprint: str = "phash", distance: int = 5) -> DataFrame:
    """(row, dup_group): the lowest row of each row's group of near-duplicates.

    Fingerprints within `distance` bits are linked; a group is a connected component. A row
    without a fingerprint is a group of its own. `row` must be unique.
    """
    links = near_pairs(df, fingerprint, distance).select(F.col("print_a").alias("a"), F.col("print_b").alias("b"))
    of = connected_components(links).select(F.col("node").alias("__print"), "component")
    rows = df.select(F.col(row).alias("row"), F.col(fingerprint).alias("print"))
    known = rows.where(F.col("print").isNotNull()).join(of, F.col("print") == F.col("__print"), "left").select("row", F.coalesce("component", "print").alias("component"))
    lowest = known.groupBy("component").agg(F.min("row").alias("dup_group"))
    grouped = known.join(lowest, "component").select("row", "dup_group")
    return grouped.unionByName(rows.where(F.col("print").isNull()).select("row", F.col("row").alias("dup_group"))).withColumnRenamed("row", row)


def redundancy_report(groups: DataFrame) -> DataFrame:
    """One row: images, distinct groups and their ratio, largest group, groups of more than one."""
    sizes = groups.groupBy("dup_group").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_images"),
        F.count("*").alias("n_groups"),
        F.round(F.try_divide(F.count("*"), F.sum("n")), 6).alias("distinct_ratio"),
        F.max("n").alias("largest_group"),
        F.count_if(F.col("n") > 1).alias("n_multi_groups"),
    )
