"""The queries of problems 1, 4 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import EXACT, with_instant
from ..operators.grid import hour_text, hourly_grid, missing_hours
from ..operators.implausible import implausible_readings
from ..operators.readings import is_number
from ..sources import read_table


def timed_readings(spark: SparkSession, d: str) -> DataFrame:
    """The readings of `hourly` whose `aqi` is a number, with their instant as `utc_us`."""
    hourly = read_table(spark, d, "hourly")
    return with_instant(hourly.where(is_number(hourly["aqi"])), read_table(spark, d, "locations"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    grid = hourly_grid(timed_readings(spark, d))
    return missing_hours(grid).select(F.col("source").alias("sensor_id"), hour_text(F.col("hour")).alias("hour_utc"))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = hourly_grid(timed_readings(spark, d))
    return grid.select(F.col("source").alias("sensor_id"), hour_text(F.col("hour")).alias("hour_utc"), F.round("value", 6).alias("aqi"), "status", "gap_hours")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(timed_readings(spark, d)).select(F.col("delivery").alias("reading_id")).distinct()


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(timed_readings(spark, d)).select(F.col("delivery").alias("reading_id"), "reason").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    hourly = read_table(spark, d, "hourly").where(~F.col("date").rlike(EXACT))
    timed = with_instant(hourly, read_table(spark, d, "locations"))
    return timed.where(F.col("utc_us").isNotNull()).select("reading_id", "utc_us")


def p6_instants(spark: SparkSession, d: str) -> DataFrame:
    return with_instant(read_table(spark, d, "hourly"), read_table(spark, d, "locations")).select("reading_id", "utc_us")


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p4_found, p4_flags, p6_found, p6_instants)}
