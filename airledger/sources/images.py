"""Pictures from files, as rows of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.pictures import picture_features, verify_maps

#: Fixed value: the code of pictures with three 8-bit channels, in the order blue, green, red.
THREE_CHANNELS = 16
ONE_CHANNEL = 0


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(image, height, width, rgb): every decodable picture below `path`, values in [0, 1].

    Gray pictures get three equal channels, a fourth channel is dropped. Files that aren't
    pictures are left out.
    """
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for origin, h, w, n, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n)
                x = np.repeat(x, 3, 2) if n == 1 else x[:, :, 2::-1]
                rows.append((origin, h, w, (x / 255.0).ravel()))
            yield pd.DataFrame(rows, columns=["image", "height", "width", "rgb"])

    return raw.select("image.*").mapInPandas(run, "image string, height int, width int, rgb array<double>")


def pixel_table(pictures: DataFrame) -> DataFrame:
    """(image, y, x, r, g, b), a row a pixel, of pictures as arrays."""
    at = F.posexplode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1))
    rows = pictures.where(F.size("rgb") == F.col("height") * F.col("width") * 3).select("image", "width", "rgb", at.alias("k", "pixel"))
    value = lambda i: F.get(F.col("rgb"), F.col("pixel") * 3 + i)
    place = [F.call_function("div", F.col("pixel"), F.col("width")).cast("int").alias("y"), (F.col("pixel") % F.col("width")).alias("x")]
    return rows.select("image", *place, value(0).alias("r"), value(1).alias("g"), value(2).alias("b"))


def build_map_cache(pictures: DataFrame, path: str, size: int = 224, patch: int = 15) -> None:
    """Transmission and inverse saturation of every picture, 8 bits a value, keyed by picture."""
    picture_features(pictures, size, patch).select("image", "maps").write.mode("overwrite").parquet(path)


def load_map_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def verify_map_cache(cached: DataFrame, pictures: DataFrame, n: int = 8, size: int = 224, patch: int = 15, most: float = 6.0) -> Row:
    """Makes the maps of `n` pictures anew and compares; AssertionError if a picture is missing or differs."""
    gone = pictures.join(cached, "image", "left_anti").limit(1).count()
    some = pictures.orderBy(F.md5(F.col("image").cast("string"))).limit(n)
    row = verify_maps(cached, picture_features(some, size, patch), most).first()
    if gone or (row["checked"] and not row["aligned"]):
        raise AssertionError(f"cached maps don't belong to these pictures: {row}")
    return row


def iter_pictures(pictures: DataFrame) -> Iterator[tuple[object, np.ndarray]]:
    """(image, height x width x 3) one by one, a partition at a time on the driver."""
    for r in pictures.toLocalIterator():
        yield r["image"], np.array(r["rgb"]).reshape(r["height"], r["width"], 3)
