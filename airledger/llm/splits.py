"""Train, calibration and test splits that keep related records together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.shares import fill_shares
from ..session import write_between

#: Wide digits, by the digit.
WIDE_DIGITS = "０１２３４５６７８９"
SPLITS = ("train", "cal", "test")


def station_number(text: Column) -> Column:
    """The number of a station, however it is written: 19001, #19001, ST-19001, 19001.0, wide
    digits, blanks around it. Null where the text holds no such number."""
    plain = F.translate(text, WIDE_DIGITS, "0123456789")
    digits = F.regexp_extract(plain, r"^[^0-9]*([0-9]+)(?:[.]0+)?[^0-9]*$", 1)
    return digits.try_cast("long")


def split_name(text: Column) -> Column:
    """train, cal or test, whatever the case and outer blanks; else null."""
    plain = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(plain.isin(*SPLITS), plain)


@dataclass
class Assignment:
    """members: (member, component, split, status) with status kept, new or quarantined.

    It is the table to persist and to hand in again with the next records.
    """

    members: DataFrame

    @property
    def quarantined(self) -> DataFrame:
        return self.members.where(F.col("status") == "quarantined")


def assign_components(sizes: DataFrame, shares: dict[str, float], links: DataFrame | None = None, table: DataFrame | None = None) -> Assignment:
    """Splits for all members, one for each component.

    `sizes` has (member, n): the entities of the new records and their numbers of records.
    `links` has (a, b): members that belong together. `table` has (member, component, split)
    of earlier runs; a member may stand in several components there, which then merge.

    Components merge by pointer jumping. A component that holds parts of earlier ones of one
    split keeps that split; one whose earlier parts have different splits is a conflicting
    merge and is quarantined (split null), so that nothing moves silently, and stays so in
    later runs; the others are new
    and fill what each split lacks of its share of all records, the largest first, each into
    the split that then lacks most. Shares are scaled to sum 1. Null members are left out; an
    empty table gives no rows.
    """
    sizes = sizes.where(F.col("member").isNotNull()).groupBy("member").agg(F.sum("n").alias("n"))
    if table is not None:
        earlier = table.where(F.col("member").isNotNull() & F.col("component").isNotNull()).select("member", "component", "split").distinct()
        homes = earlier.groupBy("member").agg(F.min("component").alias("home"))
        ids = sizes.join(homes, "member", "full").select("member", F.coalesce("n", F.lit(0)).alias("n"), "home")
    else:
        earlier, ids = None, sizes.withColumn("home", F.lit(None).cast("string"))
    ids = ids.select("member", "n", F.coalesce("home", F.concat(F.lit("new:"), F.col("member").cast("string"))).alias("home"))
    ids = write_between(ids, "members")

    edges = None
    if earlier is not None:
        edges = earlier.join(ids.select("member", "home"), "member").select(F.col("home").alias("a"), F.col("component").alias("b"))
    if links is not None:
        a, b = (ids.select(F.col("member").alias(c), F.col("home").alias(f"{c}_home")) for c in ("a", "b"))
        more = links.join(a, "a").join(b, "b").select(F.col("a_home").alias("a"), F.col("b_home").alias("b"))
        edges = more if edges is None else edges.unionByName(more)
    if edges is not None:
        roots = connected_components(edges).withColumnRenamed("node", "home")
        members = ids.join(roots, "home", "left").select("member", "n", F.coalesce("component", "home").alias("component"))
    else:
        roots, members = None, ids.withColumnRenamed("home", "component")

    known = members.groupBy("component").agg(F.sum("n").alias("n"))
    if earlier is not None:
        had = earlier.select(F.col("component").alias("home"), "split").join(roots, "home")
        had = had.groupBy("component").agg(F.min("split").alias("low"), F.max("split").alias("high"), F.max(F.col("split").isNull()).alias("out"))
        known = known.join(had, "component", "left")
    else:
        known = known.withColumns({"low": F.lit(None).cast("string"), "high": F.lit(None).cast("string"), "out": F.lit(False)})
    known = write_between(known.withColumn("out", F.coalesce(F.col("out"), F.lit(False)) | F.coalesce(F.col("low") != F.col("high"), F.lit(False))), "components")
    kept = known.where(~F.col("out") & F.col("low").isNotNull()).select("component", "n", F.col("low").alias("split"), F.lit("kept").alias("status"))
    clash = known.where("out").select("component", "n", F.lit(None).cast("string").alias("split"), F.lit("quarantined").alias("status"))
    held = {r["split"]: r["n"] for r in kept.groupBy("split").agg(F.sum("n").alias("n")).collect()}  # one row a split
    new = fill_shares(known.where(~F.col("out") & F.col("low").isNull()).select("component", "n"), shares, held).withColumn("status", F.lit("new"))
    placed = kept.unionByName(clash).unionByName(new).drop("n")
    return Assignment(members.join(placed, "component").select("member", "component", "split", "status"))


def linked_members(records: DataFrame, shared: str) -> DataFrame:
    """(a, b): links that bring together all members which have a value of `shared` in common.

    Each member is linked to the lowest of its value, so a value that many members share costs
    a link for each, not for each pair. Nulls link nothing.
    """
    held = records.where(F.col("member").isNotNull() & F.col(shared).isNotNull()).select("member", shared).distinct()
    lowest = held.groupBy(shared).agg(F.min("member").alias("b"))
    return held.join(lowest, shared).where(F.col("member") != F.col("b")).select(F.col("member").alias("a"), "b").distinct()


def read_shares(shares: DataFrame) -> dict[str, float]:
    """The proportions, a row a split."""
    return {r["split"]: r["share"] for r in shares.select("split", "share").orderBy(F.desc("share"), "split").collect()}


def present_table(records: DataFrame) -> DataFrame:
    """(member, component, split): the present splits of `records` (station_no, split) as earlier
    components, one for each station and split. Rows without either are left out."""
    known = records.where(F.col("station_no").isNotNull() & F.col("split").isNotNull()).select("station_no", "split").distinct()
    return known.select(F.col("station_no").cast("string").alias("member"), F.concat_ws("/", F.col("station_no").cast("string"), "split").alias("component"), "split")
