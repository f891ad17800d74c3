"""Sensor readings with one instant each; deliveries of one reading brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def is_number(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def floor_div(value: Column, by: int) -> Column:
    """Whole quotient rounded down, for negative values too, without going through doubles."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def one_per_instant(df: DataFrame, source: str, time: str, value: str, delivery: str) -> DataFrame:
    """One row per source and instant, with the value of the delivery that has the lowest id.

    Rows whose time is null or whose value is null or NaN are left out. The copies meet in a
    partial aggregate before the shuffle, so a reading delivered many times costs no more.
    """
    return (
        df.where(F.col(time).isNotNull() & is_number(F.col(value)))
        .groupBy(F.col(source).alias("source"), F.col(time).alias("t"))
        .agg(F.min_by(value, delivery).alias("x"))
    )
