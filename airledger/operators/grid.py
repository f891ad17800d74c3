"""Irregular readings onto a regular hourly grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .readings import HOUR_US, floor_div, one_per_instant

#: A source's series is cut into blocks of so many hours; only the edges of the blocks
#: meet per source, so that one source with a large share of all rows stays spread.
BLOCK_HOURS = 768
#: Hours that one row of a long gap stands for before it is written out.
GAP_STEP = 4096


def hour_text(hour: Column) -> Column:
    """2024-05-01T07:00:00Z of an hour since 1970, in any session time zone."""
    at = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(hours=hour.cast("int"))
    return F.concat(F.replace(at.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def hourly_values(df: DataFrame, source: str, time: str, value: str, delivery: str) -> DataFrame:
    """(source, hour, x): the mean of the readings in each full UTC hour."""
    return one_per_instant(df, source, time, value, delivery).groupBy("source", floor_div(F.col("t"), HOUR_US).alias("hour")).agg(F.avg("x").alias("x"))


def hourly_grid(
    df: DataFrame,
    source: str = "sensor_id",
    time: str = "utc_us",
    value: str = "aqi",
    delivery: str = "reading_id",
    max_fill: int = 6,
    first_hour: int | None = None,
    last_hour: int | None = None,
) -> DataFrame:
    """(source, hour, value, status, gap_hours): an even hourly series per source.

    Consecutive hours with readings are paired by `lead`; only the hours between the two of a
    pair are written out. Gaps of up to `max_fill` hours are filled on the straight line
    between their ends (status `filled`), longer ones are marked (`gap`, value null). Hours
    with readings have status `observed`. By default a series runs from its own first to its
    own last hour; with `first_hour` or `last_hour` (hours since 1970) every source is extended
    to that boundary with `outside` rows, value null.

    Rows without a time, with a null or NaN value count for nothing; a reading delivered again
    (same source and instant) counts once, by the lowest `delivery`. A null source is a source
    of its own. A source with one reading gives one row; an empty table gives none.
    """
    hours = hourly_values(df, source, time, value, delivery).withColumn("block", floor_div(F.col("hour"), BLOCK_HOURS))
    inside = Window.partitionBy("source", "block").orderBy("hour")
    paired = hours.select("*", F.lead("hour").over(inside).alias("next_hour"), F.lead("x").over(inside).alias("next_x"), F.lag("hour").over(inside).alias("last_hour"))
    within = paired.select("source", "hour", "x", "next_hour", "next_x")
    # the edges are read off the pairs, so that both come from one pass over the readings
    edges = paired.where(F.col("last_hour").isNull() | F.col("next_hour").isNull()).groupBy("source", "block").agg(
        F.min("hour").alias("low"), F.min_by("x", "hour").alias("low_x"), F.max("hour").alias("high"), F.max_by("x", "hour").alias("high_x")
    )
    along = Window.partitionBy("source").orderBy("block")
    across = edges.select("source", F.col("high").alias("hour"), F.col("high_x").alias("x"), F.lead("low").over(along).alias("next_hour"), F.lead("low_x").over(along).alias("next_x"))

    gap = F.col("next_hour") - F.col("hour") - 1
    pairs = within.unionByName(across).where(gap > 0)
    steps = pairs.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), floor_div(gap - 1, GAP_STEP))))
    start = F.col("hour") + 1 + F.col("step") * GAP_STEP
    missing = steps.withColumn("at", F.explode(F.sequence(start, F.least(start + (GAP_STEP - 1), F.col("next_hour") - 1))))
    line = F.col("x") + (F.col("next_x") - F.col("x")) * (F.col("at") - F.col("hour")) / (F.col("next_hour") - F.col("hour"))
    filled = missing.select(
        "source",
        F.col("at").alias("hour"),
        F.when(gap <= max_fill, line).alias("value"),
        F.when(gap <= max_fill, F.lit("filled")).otherwise(F.lit("gap")).alias("status"),
        gap.alias("gap_hours"),
    )
    observed = hours.select("source", "hour", F.col("x").alias("value"), F.lit("observed").alias("status"), F.lit(0).cast("long").alias("gap_hours"))
    out = observed.unionByName(filled)
    if first_hour is not None or last_hour is not None:
        ends = edges.groupBy("source").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        for bound, a, b in ((first_hour, F.lit(first_hour), F.col("low") - 1), (last_hour, F.col("high") + 1, F.lit(last_hour))):
            if bound is not None:
                a, b = a.cast("long"), b.cast("long")
                blocks = ends.where(a <= b).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), floor_div(b - a, GAP_STEP))))
                start = a + F.col("step") * GAP_STEP
                outside = blocks.select(
                    "source",
                    F.explode(F.sequence(start, F.least(start + (GAP_STEP - 1), b))).alias("hour"),
                    F.lit(None).cast("double").alias("value"),
                    F.lit("outside").alias("status"),
                    (b - a + 1).alias("gap_hours"),
                )
                out = out.unionByName(outside)
    return out


def missing_hours(grid: DataFrame) -> DataFrame:
    """(source, hour) of the grid's hours inside a series that have no reading."""
    return grid.where(F.col("status").isin("filled", "gap")).select("source", "hour")
