"""Queries over pictures made of embeddings: three vectors in turn are the channels of an 8 x 8 tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import abstain
from ..operators.pictures import five_channel_table, inverse_saturation, picture_features, picture_stats, transmission_pixels
from ..operators.pipeline import label_correlation
from ..sources import read_table


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """(image, y, x, r, g, b) with channels in [0, 1], three decimals."""
    rows = read_table(spark, d, "embeddings").where("embedding is not null and size(embedding) = 64")
    flat = rows.select(F.call_function("div", "vec_id", F.lit(3)).alias("image"), (F.col("vec_id") % 3).alias("channel"), F.posexplode("embedding").alias("pos", "v"))
    value = F.round(F.least(F.greatest(F.col("v").cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)), 3)
    at = lambda k: F.max(F.when(F.col("channel") == k, value))
    square = flat.groupBy("image", F.call_function("div", "pos", F.lit(8)).alias("y"), (F.col("pos") % 8).alias("x")).agg(at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))
    return square.where("r is not null and g is not null and b is not null")


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """(image, height, width, rgb): the same pixels as one array a picture of 64."""
    packed = pixels(spark, d).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.array("r", "g", "b").alias("c")))).alias("p"))
    return packed.select("image", F.lit(8).alias("height"), F.lit(8).alias("width"), F.flatten(F.transform("p", lambda s: s["c"])).alias("rgb"))


PIXELS_SQL = """flat as (
  select vec_id // 3 as image, vec_id % 3 as channel, pos, round(least(greatest(embedding[pos + 1]::double + 0.5, 0), 1), 3) as v
  from embeddings, (select unnest(range(64)) as pos) where embedding is not null and len(embedding) = 64),
px as (
  select image, pos // 8 as y, pos % 8 as x, max(v) filter (where channel = 0) as r, max(v) filter (where channel = 1) as g, max(v) filter (where channel = 2) as b
  from flat group by 1, 2, 3 having count(distinct channel) = 3)"""


def _dark_sql(source: str, name: str, patch: int = 3) -> str:
    h = patch // 2
    return f"""{name} as (select *, min(m) over (partition by image, x order by y rows between {h} preceding and {h} following) as dark
  from (select *, min(least(r, g, b)) over (partition by image, y order by x rows between {h} preceding and {h} following) as m from {source}))"""


TRANSMISSION_SQL = f"""with {PIXELS_SQL}, {_dark_sql("px", "d1")},
light as (select image, least(greatest(r, 1e-3), 1) as ar, least(greatest(g, 1e-3), 1) as ag, least(greatest(b, 1e-3), 1) as ab from d1 qualify row_number() over (partition by image order by dark desc, y, x) = 1),
scaled as (select image, y, x, r / ar as r, g / ag as g, b / ab as b from px join light using (image)),
{_dark_sql("scaled", "d2")}, tr as (select image, y, x, least(greatest(1 - 0.95::double * dark, 0.05), 1) as t from d2)"""


def transmission_of_pixels(spark: SparkSession, d: str) -> DataFrame:
    return transmission_pixels(pixels(spark, d), patch=3).select("image", "y", "x", F.round("t", 6).alias("t"))


def mean_transmission(spark: SparkSession, d: str) -> DataFrame:
    return transmission_pixels(pixels(spark, d), patch=3).groupBy("image").agg(F.round(F.avg("t"), 6).alias("mean_t"))


def inv_saturation_pixels(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select("image", "y", "x", F.round(inverse_saturation(F.col("r"), F.col("g"), F.col("b")), 6).alias("s"))


def handcrafted_ood(spark: SparkSession, d: str) -> DataFrame:
    stats = picture_stats(pixels(spark, d))
    b, v = F.round(F.col("brightness"), 9), F.round(F.col("detail"), 9)
    return stats.select("image", F.round("brightness", 9).alias("brightness"), F.round("detail", 6).alias("detail"), F.round("sky", 6).alias("sky"), F.round(abstain.handcrafted_score(b, v), 5).alias("score"), abstain.handcrafted_reason(b, v).alias("reason"))


def phash_features(spark: SparkSession, d: str) -> DataFrame:
    return picture_features(pictures(spark, d), patch=3).select("image", "phash", F.round("mean_t", 6).alias("mean_t"), F.round("mean_s", 6).alias("mean_s"))


def five_channel(spark: SparkSession, d: str) -> DataFrame:
    return five_channel_table(pictures(spark, d), size=8, patch=3)


def transmission_label_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Transmission against the mean label of the picture's vectors, over all pictures."""
    labels = read_table(spark, d, "embeddings").groupBy(F.call_function("div", "vec_id", F.lit(3)).alias("image")).agg(F.avg("label").alias("label"))
    return label_correlation(mean_transmission(spark, d).join(labels, "image"), "mean_t", "label", "image", n=None)


QUERIES = {f.__name__: f for f in (transmission_of_pixels, mean_transmission, inv_saturation_pixels, handcrafted_ood, phash_features, five_channel, transmission_label_correlation)}
SQL = {
    "transmission_of_pixels": f"{TRANSMISSION_SQL} select image, y, x, round(t, 6) as t from tr",
    "mean_transmission": f"{TRANSMISSION_SQL} select image, round(avg(t), 6) as mean_t from tr group by 1",
    "inv_saturation_pixels": f"""with {PIXELS_SQL}, q as (select image, y, x, greatest(floor(r * 255), floor(g * 255), floor(b * 255)) as hi, least(floor(r * 255), floor(g * 255), floor(b * 255)) as lo from px)
select image, y, x, round(1 - case when hi > 0 then floor((hi - lo) * 255 / hi + 0.5) else 0 end / 255, 6) as s from q""",
    "handcrafted_ood": f"""with {PIXELS_SQL}, g as (select *, (r + g + b) / 3 as gray from px),
s as (select image, avg(gray) as brightness, var_pop(gray) as detail, avg(case when y < 2 then case when gray > 0.5 and greatest(r, g, b) - least(r, g, b) < 0.2 then 1.0 else 0 end end) as sky from g group by 1),
p as (select *, greatest(0, (0.25 - round(brightness, 9)) / 0.25) as dark, greatest(0, (0.003 - round(detail, 9)) / 0.003) as flat from s)
select image, round(brightness, 9) as brightness, round(detail, 6) as detail, round(sky, 6) as sky, round(greatest(dark, flat), 5) as score, case when dark >= flat then 'too dark' else 'too flat' end as reason from p""",
}
