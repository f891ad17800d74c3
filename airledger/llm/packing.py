"""Items of varying size into containers of a fixed capacity, by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_between

#: Items of one size are numbered in groups of about so many, 256 groups at least.
GROUPED = 1 << 16


def fill_one(capacity: int, sizes: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """(place in `sizes`, how many) of the items that fill one container closest to its capacity.

    `sizes` falls strictly. The largest item left goes in; for the room that remains, a set of
    reachable sums is kept as the bits of one integer and grows size by size, from large to
    small, until the room itself is reachable or the sizes end. The counts are then traced
    back from the highest reachable sum.
    """
    room = capacity - sizes[0]
    full, one = (1 << (room + 1)) - 1, 1
    reach, seen = one, []
    for k, size in enumerate(sizes):
        if size > room:
            continue
        left = min(counts[k] - (k == 0), room // size)
        if left < 1:
            continue
        before, step, shift = reach, 1, size
        while left > 0:  # any count up to `left` as a sum of doubling steps
            take = min(step, left)
            shift = size * take
            reach |= (reach << shift) & full
            left -= take
            step *= 2
        seen.append((k, before))
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used = {0: 1}
    for k, before in reversed(seen):
        n = 0
        while not before >> at & 1:
            at -= sizes[k]
            n += 1
        if n:
            used[k] = used.get(k, 0) + n
    return sorted(used.items())


def plan_containers(capacity: int, histogram: dict[int, int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(size, how many)]) of containers that hold all items of `histogram`.

    A filling is repeated as often as the counts allow, so each step uses up a size: there are
    no more fillings than sizes, and no more sizes than the capacity, however many items.
    """
    sizes = sorted((s for s, c in histogram.items() if c > 0 and s > 0), reverse=True)
    counts = [histogram[s] for s in sizes]
    plan = []
    while sizes:
        used = fill_one(capacity, sizes, counts)
        repeats = min(counts[k] // n for k, n in used)
        plan.append((repeats, [(sizes[k], n) for k, n in used]))
        for k, n in used:
            counts[k] -= n * repeats
        if any(not counts[k] for k, _ in used):
            live = [k for k, c in enumerate(counts) if c]
            sizes, counts = [sizes[k] for k in live], [counts[k] for k in live]
    return plan


def places_of(plan: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """Where the items of each size go: (size and first number, first number, items of the size in
    one container, first container) of the intervals of their numbers, in order."""
    rows, at, next_pack = [], {}, 0
    for repeats, filling in plan:
        for size, n in filling:
            start = at.get(size, 0)
            rows.append((size, start, n, next_pack))
            at[size] = start + n * repeats
        next_pack += repeats
    rows.sort()
    key = np.array([(size, start) for size, start, _, _ in rows], dtype="i8,i8")
    return key, *(np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3))


def find_place(places: tuple[np.ndarray, ...], size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Container of the `number`-th item (from 0) of a size."""
    key, start, each, pack = places
    asked = np.empty(len(size), dtype="i8,i8")
    asked["f0"], asked["f1"] = size, number
    at = np.searchsorted(key, asked, side="right") - 1
    return pack[at] + (number - start[at]) // each[at]


def pack_items(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(pack_id, key, part, start, n_tokens): one row per item, or per piece of an item.

    An item is divided only if it alone exceeds the capacity: its full pieces are containers
    of their own, the rest is packed like an item. Items of size 0 take no room and stand in
    the first container. Null sizes count as 0. `key` must be unique.

    The driver plans with the numbers of items of each size only: at most `capacity` rows,
    however many items there are. The items of a size are numbered in groups, then placed by
    the plan's intervals, which are bounded by the capacity too.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)[key]
    sized = items.select(F.col(key).alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("whole"))
    rest = sized.select("key", "whole", F.pmod("whole", F.lit(capacity)).alias("rest"))
    histogram = {r["rest"]: r["c"] for r in rest.groupBy("rest").agg(F.count("*").alias("c")).collect()}  # at most `capacity` rows
    groups_of = max(256, sum(histogram.values()) // GROUPED)
    plan = plan_containers(capacity, {s: c for s, c in histogram.items() if s})
    planned = sum(repeats for repeats, _ in plan)
    spread = spark.sparkContext.broadcast(places_of(plan))

    numbered = rest.where("rest > 0").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(groups_of)))
    groups = numbered.groupBy("rest", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    groups = groups.select("rest", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("key")) - 1
    numbered = numbered.withColumn("inside", inside).join(groups, ["rest", "bucket"]).select("key", "whole", "rest", (F.col("offset") + F.col("inside")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pack = find_place(spread.value, b.column(2).to_numpy(), b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(pack, pa.int64()), b.column(0), b.column(1), b.column(2)], names=["pack_id", "key", "whole", "rest"])

    placed = numbered.mapInArrow(place, f"pack_id long, key {kind}, whole long, rest long").select(
        "pack_id", "key", F.call_function("div", "whole", F.lit(capacity)).alias("part"), (F.col("whole") - F.col("rest")).alias("start"), F.col("rest").alias("n_tokens")
    )
    large = rest.where(F.col("whole") >= capacity).withColumn("pieces", F.call_function("div", "whole", F.lit(capacity)))
    before = Window.partitionBy("group").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    large = large.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups_of)))
    offsets = large.groupBy("group").agg(F.sum("pieces").alias("p"))
    over_groups = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    offsets = offsets.select("group", (F.coalesce(F.sum("p").over(over_groups), F.lit(0)) + planned).alias("offset"))
    large = large.withColumn("inside", F.coalesce(F.sum("pieces").over(before), F.lit(0))).join(offsets, "group")
    full = large.select("key", (F.col("offset") + F.col("inside")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("part")).select(
        (F.col("first") + F.col("part")).alias("pack_id"), "key", "part", (F.col("part") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_tokens")
    )
    zero = F.lit(0).cast("long")
    empty = rest.where("whole = 0").select(zero.alias("pack_id"), "key", zero.alias("part"), zero.alias("start"), zero.alias("n_tokens"))
    return placed.unionByName(full).unionByName(empty).withColumnRenamed("key", key)


def pack_all(items: DataFrame, packs: list[tuple[str, int]], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """`pack_items` for each (name, capacity), with columns pack_name and capacity."""
    items = write_between(items.select(key, size), "sizes")
    out = None
    for name, capacity in packs:
        one = pack_items(items, capacity, key, size).select(F.lit(name).alias("pack_name"), F.lit(capacity).cast("long").alias("capacity"), "*")
        out = one if out is None else out.unionByName(one)
    return out
