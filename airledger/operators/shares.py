"""Whole groups into parts of given shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_between

#: What a part lacks is counted in such fractions of a record, so that all sums are whole numbers.
FRACTION = 1000


def deal(lacks: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each part gets, if each group in turn goes to the part
    that lacks most, the first of them on ties.

    Part i offers the places lacks[i], lacks[i] - size, lacks[i] - 2 * size, ...; going to the
    largest lack in turn takes the `count` highest of them. The height of the last one is found
    by halving, so the work doesn't grow with `count`.
    """
    if count == 1 or size < 1:  # groups without records take nothing, all go to the same part
        best = max(range(len(lacks)), key=lambda i: lacks[i])
        return [count * (i == best) for i in range(len(lacks))]
    above = lambda v: [max(0, (x - v) // size + 1) for x in lacks]  # noqa: E731 - places at v or higher
    low, high = min(lacks) - size * count, max(lacks)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(above(middle)) >= count else (low, middle - 1)
    given = above(low + 1)
    for i, x in enumerate(lacks):
        if sum(given) < count and x >= low and (x - low) % size == 0:
            given[i] += 1
    return given


def plan_parts(histogram: dict[int, int], lacks: list[int]) -> dict[int, list[int]]:
    """By size of groups: how many of its groups each part gets. The largest groups are dealt first."""
    lacks, plan = list(lacks), {}
    for size in sorted(histogram, reverse=True):
        plan[size] = deal(lacks, size * FRACTION, histogram[size])
        lacks = [x - size * FRACTION * k for x, k in zip(lacks, plan[size])]
    return plan


def targets(shares: dict[str, float], total: int) -> list[int]:
    """What each part should hold, in fractions of a record; shares are scaled to sum 1."""
    whole = sum(shares.values())
    return [round(s / whole * total * FRACTION) for s in shares.values()]


def size_histogram(groups: DataFrame) -> dict[int, int]:
    """Number of groups by size: at most sqrt(2 * records) rows, since sizes that differ add up."""
    return {r["n"]: r["c"] for r in groups.groupBy("n").agg(F.count("*").alias("c")).collect()}


def numbered(groups: DataFrame, seed: int = 42) -> DataFrame:
    """`groups` (component, n) with `number`, from 0 along a fixed random order of the groups of one size.

    Groups are numbered by bucket of their random key, so that a size which most groups have
    is spread over 65,536 of them.
    """
    keyed = groups.select("component", "n", F.md5(F.concat(F.col("component").cast("string"), F.lit(f"#{seed}"))).alias("key")).withColumn("bucket", F.substring("key", 1, 4))
    before = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
    offsets = keyed.groupBy("n", "bucket").agg(F.count("*").alias("c")).select("n", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("n", "bucket").orderBy("key", "component")) - 1
    return keyed.withColumn("inside", inside).join(offsets, ["n", "bucket"]).select("component", "n", (F.col("offset") + F.col("inside")).alias("number"))


def placed(groups: DataFrame, plan: dict[int, list[int]], names: list[str], out: str = "split") -> DataFrame:
    """Numbered groups with the part that the plan gives them: of one size, the first go to the part named first.

    The plan is broadcast: it has a row a size, so at most sqrt(2 * records) of them.
    """
    rows = [(size, [sum(counts[: i + 1]) for i in range(len(names))]) for size, counts in plan.items()]
    ends = groups.sparkSession.createDataFrame(rows, "n long, ends array<long>")
    part = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        part = F.when(F.col("number") < F.get("ends", F.lit(i)), names[i]).otherwise(part)
    return groups.join(F.broadcast(ends), "n").select("component", "n", part.alias(out))


def fill_shares(groups: DataFrame, shares: dict[str, float], held: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """`groups` (component, n) with the column `split`.

    Each split lacks its share of all records less what it holds already (`held`). The groups
    go one by one, the largest first, into the split that then lacks most (the first named on
    ties). Groups of one size can stand for each other, so the driver plans with the number
    of groups of each size; which of them a split gets follows a fixed random order. Shares
    are scaled to sum 1; groups need unique, non-null components and at least one record
    each. An empty table gives no rows.
    """
    groups = write_between(groups.select("component", "n"), "groups")
    held, names = held or {}, list(shares)
    histogram = size_histogram(groups)
    total = sum(n * c for n, c in histogram.items()) + sum(held.values())
    lacks = [x - FRACTION * held.get(s, 0) for s, x in zip(names, targets(shares, total))]
    return placed(numbered(groups, seed), plan_parts(histogram, lacks), names)
