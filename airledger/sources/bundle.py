"""Fitted parameters as one JSON row, and reports as CSV and JSON."""

from __future__ import annotations

import json

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

NEEDED = ("q", "y_mean", "y_std", "tau_ood", "tau_width")


def save_bundle(spark: SparkSession, path: str, **values) -> None:
    """Scalars and short lists (knots, a mean, a precision matrix) in one row."""
    missing = [k for k in NEEDED if k not in values]
    if missing:
        raise ValueError(f"bundle lacks {', '.join(missing)}")
    spark.createDataFrame([(json.dumps(values),)], "bundle string").coalesce(1).write.mode("overwrite").text(path)


def load_bundle(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path).take(2)
    if len(rows) != 1:
        raise FileNotFoundError(f"no bundle in {path}")
    return {"handcrafted_tau": 0.5} | json.loads(rows[0][0])


def save_fit(spark: SparkSession, path: str, **arrays) -> None:
    """Fitted arrays (a mean, a precision matrix) as one row each: (name, shape, values)."""
    rows = [(name, list(np.shape(x)), np.asarray(x, dtype=float).ravel().tolist()) for name, x in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def load_fit(spark: SparkSession, path: str) -> dict[str, np.ndarray] | None:
    """The arrays that `save_fit` wrote, or None where there are none."""
    try:
        rows = spark.read.parquet(path).collect()
    except AnalysisException:
        return None
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows}


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A report as CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)
