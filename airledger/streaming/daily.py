"""The per-day table of hourly readings kept up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aqi import pm25_to_aqi


def daily_stream(readings: DataFrame, min_hours: int = 18, late: str = "2 days", convention: int = 2012, most: float = 1000.0, time: str = "datetime") -> DataFrame:
    """(station, day, n_hours, day_mean_aqi, within_day_var) of a stream of readings (location_id,
    `time`, pm25_ugm3), a row once a day is over and `late` has passed.

    State is one running aggregate per station and open day; readings later than `late`
    are dropped. On the same rows it gives what the batch operator gives.
    """
    at = F.try_to_timestamp(F.col(time))
    x = F.col("pm25_ugm3").try_cast("double")
    rows = readings.select(F.col("location_id").alias("station"), at.alias("at"), x.alias("c")).where(F.col("station").isNotNull() & F.col("at").isNotNull() & (F.col("c") >= 0) & (F.col("c") <= most))
    rows = rows.withWatermark("at", late).select("station", "at", pm25_to_aqi(F.col("c"), convention).alias("aqi"))
    days = rows.groupBy("station", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n_hours"), F.avg("aqi").alias("day_mean_aqi"), F.var_samp("aqi").alias("within_day_var"))
    return days.where(F.col("n_hours") >= min_hours).select("station", F.to_date("w.start").alias("day"), "n_hours", "day_mean_aqi", "within_day_var")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Handles all input that is there, appends finished days to `path` and stops."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
