"""Queries: named plans over the tables of one directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extras, general, general_sql, pictures, reference

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return general.QUERIES | reference.QUERIES | pictures.QUERIES | extras.QUERIES


def all_sql() -> dict[str, str]:
    return general_sql.SQL | reference.SQL | pictures.SQL | extras.SQL


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    return reference.contaminated_vs_clean(spark, directory)
