"""Features of pictures: relational forms over pixels and vectorised forms over arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Normalisation of the colour channels and of the two maps.
RGB_MEAN, RGB_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
MAP_MEAN, MAP_STD = (0.70, 0.30), (0.20, 0.20)


def dark_pixels(pixels: DataFrame, patch: int = 15, r: str = "r", g: str = "g", b: str = "b", out: str = "dark") -> DataFrame:
    """`pixels` (image, y, x, r, g, b) with the least channel value around each pixel.

    The square neighbourhood is a row and then a column of neighbours; pixels outside don't count.
    """
    half = patch // 2
    along = lambda keep, order: Window.partitionBy("image", keep).orderBy(order).rowsBetween(-half, half)
    rows = pixels.withColumn("__least", F.least(r, g, b)).withColumn("__row", F.min("__least").over(along("y", "x")))
    return rows.withColumn(out, F.min("__row").over(along("x", "y"))).drop("__least", "__row")


def atmospheric_light(pixels: DataFrame, top_share: float = 0.001) -> DataFrame:
    """(image, ar, ag, ab): the brightest of the haziest pixels; ties go to the first in reading order.

    Pixels of one picture are bounded by its size.
    """
    order = Window.partitionBy("image").orderBy(F.desc("dark"), "y", "x")
    whole = Window.partitionBy("image")
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(whole) * top_share))
    top = pixels.withColumn("__k", F.row_number().over(order)).withColumn("__n", n).where(F.col("__k") <= F.col("__n"))
    best = top.groupBy("image").agg(F.max_by(F.struct("r", "g", "b"), F.struct((F.col("r") + F.col("g") + F.col("b")), -F.col("y"), -F.col("x"))).alias("a"))
    clip = lambda c: F.least(F.greatest(F.col(f"a.{c}"), F.lit(1e-3)), F.lit(1.0)).alias(f"a{c}")
    return best.select("image", *(clip(c) for c in "rgb"))


def transmission_pixels(pixels: DataFrame, patch: int = 15, omega: float = 0.95, top_share: float = 0.001, least: float = 0.05) -> DataFrame:
    """(image, y, x, t): transmission of each pixel from the dark channel of the picture over its light."""
    light = atmospheric_light(dark_pixels(pixels, patch), top_share)
    scaled = pixels.join(light, "image").select("image", "y", "x", *((F.col(c) / F.col(f"a{c}")).alias(c) for c in "rgb"))
    t = 1 - omega * F.col("dark")
    return dark_pixels(scaled, patch).select("image", "y", "x", F.least(F.greatest(t, F.lit(least)), F.lit(1.0)).alias("t"))


def inverse_saturation(r: Column, g: Column, b: Column) -> Column:
    """1 less the saturation of a colour given in [0, 1], on 8-bit values: channels are cut to
    whole steps, the saturation is rounded to one."""
    r, g, b = (F.floor(c * 255) for c in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return 1 - F.coalesce(F.floor(F.try_divide((high - low) * 255, F.when(high > 0, high)) + 0.5), F.lit(0)) / 255.0


def picture_stats(pixels: DataFrame) -> DataFrame:
    """(image, brightness, detail, sky): mean value, variance of the gray picture, share of bright
    gray pixels in the top third."""
    gray = (F.col("r") + F.col("g") + F.col("b")) / 3
    height = F.max("y").over(Window.partitionBy("image")) + 1
    sky = F.when(F.col("y") < F.greatest(F.lit(1), F.floor(F.col("height") * 0.34)), F.when((gray > 0.5) & (F.greatest("r", "g", "b") - F.least("r", "g", "b") < 0.2), 1.0).otherwise(0.0))
    return pixels.withColumn("height", height).groupBy("image").agg(F.avg(gray).alias("brightness"), F.var_pop(gray).alias("detail"), F.avg(sky).alias("sky"))


# vectorised forms, one picture an array


def erode(x: np.ndarray, patch: int) -> np.ndarray:
    half = patch // 2
    view = np.lib.stride_tricks.sliding_window_view
    rows = view(np.pad(x, ((0, 0), (half, half)), constant_values=np.inf), patch, axis=1).min(-1)
    return view(np.pad(rows, ((half, half), (0, 0)), constant_values=np.inf), patch, axis=0).min(-1)


def haze_colour(rgb: np.ndarray, dark: np.ndarray, top_share: float) -> np.ndarray:
    """As `atmospheric_light`: rows (dark, brightness, place) are ordered twice; ties go to the first in reading order."""
    place = np.arange(dark.size)
    haziest = np.lexsort((place, -dark.ravel()))[: max(1, int(dark.size * top_share))]
    brightness = rgb.sum(2).ravel()[haziest]
    y, x = np.unravel_index(haziest[np.lexsort((haziest, -brightness))[0]], dark.shape)
    return rgb[y, x].clip(1e-3, 1.0)


def transmission(rgb: np.ndarray, patch: int = 15, omega: float = 0.95, top_share: float = 0.001, least: float = 0.05) -> np.ndarray:
    light = haze_colour(rgb, erode(rgb.min(2), patch), top_share)
    return np.clip(1 - omega * erode((rgb / light).min(2), patch), least, 1.0)


def inverse_saturation_map(rgb: np.ndarray) -> np.ndarray:
    v = np.floor(rgb * 255)
    high, low = v.max(2), v.min(2)
    s = np.floor(np.divide((high - low) * 255, high, out=np.zeros_like(high), where=high > 0) + 0.5)
    return 1 - s / 255


def resize(rgb: np.ndarray, size: int) -> np.ndarray:
    """Bilinear with the filter widened when a side shrinks, on 8-bit steps."""

    def weights(old: int) -> np.ndarray:
        scale = old / size
        reach = max(1.0, scale)
        middle = (np.arange(size) + 0.5) * scale
        w = np.maximum(0, 1 - np.abs((np.arange(old) + 0.5)[None, :] - middle[:, None]) / reach)
        return w / w.sum(1, keepdims=True)

    v = np.floor(rgb * 255)
    out = np.einsum("ij,jkc->ikc", weights(v.shape[0]), v)
    return np.clip(np.floor(np.einsum("ij,kjc->kic", weights(v.shape[1]), out) + 0.5), 0, 255) / 255


def five_channels(rgb: np.ndarray, t: np.ndarray, s: np.ndarray) -> np.ndarray:
    """(5, h, w): standardised colours, transmission and inverse saturation."""
    colour = (rgb - RGB_MEAN) / RGB_STD
    maps = (np.stack([t, s], 2) - MAP_MEAN) / MAP_STD
    return np.concatenate([colour, maps], 2).transpose(2, 0, 1)


def phash(gray: np.ndarray, side: int = 8) -> int:
    """64 bits: which low frequencies of the cosine transform of a 32 x 32 gray picture exceed their median."""
    n = 4 * side
    small = resize(np.repeat(gray[:, :, None], 3, 2), n)[:, :, 0] * 255
    k = np.arange(n)
    cosine = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (cosine @ small @ cosine.T)[:side, :side]
    bits = (low > np.median(low)).ravel()
    value = int("".join("1" if x else "0" for x in bits), 2)
    return value - (1 << 64) if value >> 63 else value


def picture_features(pictures: DataFrame, size: int = 32, patch: int = 15) -> DataFrame:
    """(image, phash, mean_t, mean_s, maps): features of pictures (image, height, width, rgb as a flat
    array in [0, 1]). A null or badly sized array gives nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for image, h, w, flat in zip(pdf["image"], pdf["height"], pdf["width"], pdf["rgb"]):
                if flat is None or len(flat) != h * w * 3:
                    rows.append((image, None, None, None, None))
                    continue
                rgb = resize(np.asarray(flat, dtype=float).reshape(h, w, 3), size)
                t, s = transmission(rgb, patch), inverse_saturation_map(rgb)
                maps = np.clip(np.stack([t, s]) * 255, 0, 255).astype(np.uint8).tobytes()
                rows.append((image, phash(rgb.mean(2)), float(t.mean()), float(s.mean()), maps))
            yield pd.DataFrame(rows, columns=["image", "phash", "mean_t", "mean_s", "maps"]).astype({"phash": "Int64"})

    kind = dict(pictures.dtypes)["image"]
    return pictures.select("image", "height", "width", "rgb").mapInPandas(run, f"image {kind}, phash long, mean_t double, mean_s double, maps binary")


def five_channel_table(pictures: DataFrame, size: int = 32, patch: int = 15) -> DataFrame:
    """(image, tensor): flat (5, size, size) input of a model for each picture."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for image, h, w, flat in zip(pdf["image"], pdf["height"], pdf["width"], pdf["rgb"]):
                rgb = resize(np.asarray(flat, dtype=float).reshape(h, w, 3), size)
                rows.append((image, five_channels(rgb, transmission(rgb, patch), inverse_saturation_map(rgb)).ravel().astype(np.float32)))
            yield pd.DataFrame(rows, columns=["image", "tensor"])

    kind = dict(pictures.dtypes)["image"]
    return pictures.where(F.col("rgb").isNotNull() & (F.size("rgb") == F.col("height") * F.col("width") * 3)).select("image", "height", "width", "rgb").mapInPandas(run, f"image {kind}, tensor array<float>")


def float_rgb(x: np.ndarray) -> np.ndarray:
    """A picture as height x width x 3 in [0, 1]: values over 1 mean steps of 255, a gray one gets three channels."""
    x = np.asarray(x, dtype=np.float64)
    x = x / 255 if x.size and x.max() > 1 else x
    return np.repeat(x[:, :, None], 3, axis=2) if x.ndim == 2 else x


def five_channel_cached(pictures: DataFrame, cached: DataFrame, size: int = 32) -> DataFrame:
    """(image, tensor) with the two maps taken from the cache (image, maps) by the picture's key.

    The cache is checked first: LookupError if a picture has no maps there, ValueError if maps
    have another size.
    """
    if not pictures.join(cached.select("image"), "image", "left_anti").isEmpty():
        raise LookupError("a picture has no maps in the cache")
    if not cached.where(F.octet_length("maps") != 2 * size * size).isEmpty():
        raise ValueError(f"the cached maps aren't {size} x {size}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for image, h, w, flat, maps in zip(*(pdf[c] for c in ("image", "height", "width", "rgb", "maps"))):
                t, s = np.frombuffer(maps, np.uint8).reshape(2, size, size) / 255.0
                rows.append((image, five_channels(resize(np.asarray(flat, dtype=float).reshape(h, w, 3), size), t, s).ravel().astype(np.float32)))
            yield pd.DataFrame(rows, columns=["image", "tensor"])

    both = pictures.where(F.col("rgb").isNotNull()).join(cached.where(F.col("maps").isNotNull()).select("image", "maps"), "image")
    return both.select("image", "height", "width", "rgb", "maps").mapInPandas(run, f"image {dict(pictures.dtypes)['image']}, tensor array<float>")


def moved(x: np.ndarray, flip: bool, angle: float, top: float, left: float, height: float, width: float) -> np.ndarray:
    """Channels x side x side: mirrored, turned by `angle` degrees about the middle (0 outside), and the window
    (shares of the side) cut out and brought back to the full size, bilinearly in one step."""
    side = x.shape[1]
    at = (np.arange(side) + 0.5) / side
    v, u = np.meshgrid(top + height * at - 0.5, left + width * at - 0.5, indexing="ij")
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    v, u = c * v - s * u, s * v + c * u
    u = -u if flip else u
    row, col = (v + 0.5) * side - 0.5, (u + 0.5) * side - 0.5
    inside = (row > -0.5) & (row < side - 0.5) & (col > -0.5) & (col < side - 0.5)
    row, col = np.clip(row, 0, side - 1), np.clip(col, 0, side - 1)
    r0, c0 = np.floor(row).astype(int), np.floor(col).astype(int)
    r1, c1 = np.minimum(r0 + 1, side - 1), np.minimum(c0 + 1, side - 1)
    a, b = row - r0, col - c0
    out = (1 - a) * ((1 - b) * x[:, r0, c0] + b * x[:, r0, c1]) + a * ((1 - b) * x[:, r1, c0] + b * x[:, r1, c1])
    return np.where(inside, out, 0.0)


def augmented(tensors: DataFrame, size: int, epoch: int = 0, seed: int = 42, degrees: float = 8.0, scale: tuple[float, float] = (0.85, 1.0), ratio: tuple[float, float] = (0.9, 1.1)) -> DataFrame:
    """(image, tensor): each picture moved at random, all channels together; the same for the same image, epoch and seed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for image, key, flat in zip(pdf["image"], pdf["key"], pdf["tensor"]):
                rng = np.random.default_rng(int(key, 16))
                area, shape = rng.uniform(*scale), np.exp(rng.uniform(*np.log(ratio)))
                h, w = min(1.0, np.sqrt(area / shape)), min(1.0, np.sqrt(area * shape))
                x = moved(np.asarray(flat, dtype=float).reshape(-1, size, size), rng.random() < 0.5, rng.uniform(-degrees, degrees), rng.uniform(0, 1 - h), rng.uniform(0, 1 - w), h, w)
                rows.append((image, x.ravel().astype(np.float32)))
            yield pd.DataFrame(rows, columns=["image", "tensor"])

    key = F.substring(F.md5(F.concat_ws("|", F.col("image").cast("string"), F.lit(f"{epoch}#{seed}"))), 1, 15)
    return tensors.select("image", key.alias("key"), "tensor").mapInPandas(run, f"image {dict(tensors.dtypes)['image']}, tensor array<float>")


def verify_maps(cached: DataFrame, fresh: DataFrame, most: float = 6.0) -> DataFrame:
    """One row (checked, mean_abs_diff, aligned) of cached maps against fresh ones of the same pictures."""

    @F.pandas_udf("double")
    def difference(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.abs(np.frombuffer(x, np.uint8).astype(int) - np.frombuffer(y, np.uint8)).mean()) for x, y in zip(a, b)])

    both = cached.select("image", F.col("maps").alias("a")).join(fresh.select("image", F.col("maps").alias("b")), "image").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    diff = both.select(difference("a", "b").alias("d"))
    return diff.agg(F.count("*").alias("checked"), F.avg("d").alias("mean_abs_diff"), F.coalesce(F.max("d") <= most, F.lit(False)).alias("aligned"))
