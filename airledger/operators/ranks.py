"""Numbers of rows along a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_between


def with_row_number(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """`df` with the number of each row (from 1) along `order`, which must be total.

    The rows are cut into ranges of the order and written once, so that the ranges stay what
    they are; each is numbered by itself and shifted by the sizes of those before it, one row
    per range. Ties broken by the last column of `order` keep frequent values divisible.
    """
    ranged = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged = write_between(ranged, "ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__inside", inside).join(offsets, "__range").withColumn(out, F.col("__inside") + F.col("__offset")).drop("__range", "__inside", "__offset")


def with_running_sum(df: DataFrame, order: list[Column], value: Column, out: str = "running") -> DataFrame:
    """`df` with its row number `rank` and the sum of `value` up to each row along `order`."""
    ranged = df.withColumn("__run_value", value.cast("double")).repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged = write_between(ranged, "ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"), F.sum("__run_value").alias("__s"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__run_before"))
    inside = Window.partitionBy("__range").orderBy(*order)
    numbered = ranged.select("*", F.row_number().over(inside).alias("__inside"), F.sum("__run_value").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("__run_in"))
    numbered = numbered.join(offsets, "__range").withColumn("rank", F.col("__inside") + F.col("__offset")).withColumn(out, F.col("__run_in") + F.col("__run_before"))
    return numbered.drop("__range", "__inside", "__offset", "__run_in", "__run_before", "__run_value")


def with_last_before(df: DataFrame, marks: DataFrame, at: str, value: str) -> DataFrame:
    """`df` with `value` of the last row of `marks` whose `at` is not past its own; null before the first.

    Both tables stand in one order of `at`, cut into ranges and written once; inside a range the
    last mark is carried along, between ranges the last mark of each, one row per range. No
    key of either side is matched with another, so neither can be hot. Rows of `df` whose
    `at` is null are left out; of marks at one place the last by `value` holds.
    """
    own = df.where(F.col(at).isNotNull()).select(F.col(at).cast("double").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(dict(marks.dtypes)[value]).alias("__mark"), F.struct(*df.columns).alias("__row"))
    other = marks.where(F.col(at).isNotNull()).select(F.col(at).cast("double").alias("__at"), F.lit(0).alias("__kind"), F.col(value).alias("__mark"))
    order = [F.col("__at"), F.col("__kind"), F.col("__mark")]
    both = own.unionByName(other, allowMissingColumns=True).repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    both = write_between(both, "ranges")
    ranges = both.select("__range").distinct()
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carried = both.where("__kind = 0").groupBy("__range").agg(F.max_by("__mark", F.struct("__at", "__mark")).alias("__last"))
    carried = ranges.join(carried, "__range", "left").select("__range", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("__own", F.last("__mark", ignorenulls=True).over(inside)).where("__kind = 1").join(carried, "__range")
    return marked.select("__row.*", F.coalesce("__own", "__carried").alias(value))


def with_average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """`df` with the rank of `value` among all rows, equal values sharing their average rank.

    Equal values are counted first; the running count goes over distinct values only.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("__c"))
    ranks = with_running_sum(counts, [F.col(value)], F.col("__c"), "__upto")
    ranks = ranks.select(F.col(value).alias("__v"), (F.col("__upto") - (F.col("__c") - 1) / 2).alias(out))
    return df.join(ranks, df[value].eqNullSafe(F.col("__v"))).drop("__v")


def order_statistic(df: DataFrame, value: str, rank: Column, n_name: str = "n") -> DataFrame:
    """One row (n, value): the value at `rank`, a function of the number `n` of non-null rows.

    Equal values are counted before they are ordered. No row where the table has none.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    upto = with_running_sum(counts, [F.col(value)], F.col("c"), "upto")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias(n_name))
    hit = upto.join(F.broadcast(total))  # `total` is one row
    at = rank.cast("double")
    return hit.where((F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)).select(n_name, value)


def running_by_key(counts: DataFrame, keys: list[str], value: str, weight: str, out: str = "upto") -> DataFrame:
    """`counts` (keys, value, weight; one row each) with the sum of `weight` up to each value of its key.

    The rows are cut into ranges of (keys, value) and written once, so that a key with many
    values is spread over ranges; what lies before a range is one row a key and range.
    """
    order = [F.col(c) for c in (*keys, value)]
    ranged = counts.select(*keys, value, weight).repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged = write_between(ranged, "ranges")
    sums = ranged.groupBy(*keys, "__range").agg(F.sum(weight).alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    sums = sums.select(*(F.col(c).alias(f"__{c}") for c in keys), F.col("__range").alias("__at"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inside = F.sum(weight).over(Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    joined = ranged.withColumn("__in", inside).join(sums, [*same, F.col("__range") == F.col("__at")])
    return joined.select(*keys, value, weight, (F.col("__in") + F.col("__before")).alias(out))


def middle_values(counts: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, n, middle): the exact median of `value`, which occurs `weight` times, and the number of
    values for each key. A null key is a key; `value` must not be null."""
    upto = running_by_key(counts, keys, value, weight)
    totals = counts.groupBy(*keys).agg(F.sum(weight).alias("n")).withColumnsRenamed({c: f"__{c}" for c in keys})
    both = upto.join(totals, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    at = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col(weight) < rank), F.col(value)))
    return both.groupBy(*keys).agg(F.max("n").alias("n"), ((at(low) + at(high)) / 2).alias("middle"))


def percentiles_by_key(df: DataFrame, keys: list[str], value: str, q: dict[str, float]) -> DataFrame:
    """(keys, n, one column for each of `q`): exact percentiles of `value`, on the straight line between
    neighbouring ranks. Without keys one row; null where there are no values. Null values don't
    count, a null key is a key.

    Equal values are counted first, and the counts ordered by ranges: no task holds all values
    of a key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__w"))
    upto = running_by_key(counts, keys, "__x", "__w", "__upto")
    totals = counts.groupBy(*keys).agg(F.coalesce(F.sum("__w"), F.lit(0)).alias("n")).withColumnsRenamed({c: f"__{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    both = totals.join(upto, same, "left") if keys else F.broadcast(totals).join(upto, how="left")  # without keys one row
    at = lambda rank: F.max(F.when((F.col("__upto") >= rank) & (F.col("__upto") - F.col("__w") < rank), F.col("__x")))
    out = []
    for name, p in q.items():
        place = (F.col("n") - 1) * F.lit(p)
        low = F.floor(place)
        share = F.max(place - low)
        first, second = at(low + 1), at(F.least(low + 2, F.col("n")))
        out.append((first + (second - first) * share).alias(name))
    by = [F.col(f"__{c}").alias(c) for c in keys]
    return both.groupBy(*by).agg(F.max("n").alias("n"), *out)


def md5_key(*parts: Column, seed: int = 42) -> Column:
    """A key whose order is a fixed random order of the rows: md5 of the parts and the seed."""
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts), F.lit(f"#{seed}")))
