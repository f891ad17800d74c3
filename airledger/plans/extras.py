"""More queries of the evaluation operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aqi
from ..operators import abstain, calibrate, pipeline
from ..operators.grid import hourly_grid
from ..operators.pictures import augmented, five_channel_cached, five_channel_table
from ..operators.readings import HOUR_US, floor_div
from ..session import shared_dir
from ..sources import read_table
from ..sources.feeds import find_folders, folder_rollup
from ..sources.images import build_map_cache, load_map_cache
from . import general_sql as hours_sql
from .general import timed_readings
from .pictures import TRANSMISSION_SQL, mean_transmission, pictures
from .reference import _POINT_SQL, R, rounded
from .views import PHOTOS_SQL, predictions, predictions_sql


def aqi_colours(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "photos").groupBy(aqi.category_colour(F.col("pm25")).alias("colour")).agg(F.count("*").alias("n"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Two members: the baseline, and the same with wider quantiles and higher points."""
    first = predictions(spark, d).withColumn("member", F.lit(0))
    second = first.withColumns({"member": F.lit(1), "q05": F.col("q05") * 0.81, "q50": F.col("q50") * 1.21, "q95": F.col("q95") * 1.44, "point": F.col("point") + 6})
    return first.unionByName(second)


MEMBERS_SQL = f"""with {PHOTOS_SQL}, {predictions_sql()},
avgd as (select row_id, station_id, split, y, q05 * 0.9 as q05, q50 * 1.1 as q50, q95 * 1.2 as q95, point + 3 as point from pred)"""


def tta_mean(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of each photo and of its mirror image (here the second member), averaged."""
    out = calibrate.averaged_outputs(_members(spark, d), ["row_id"], ["q05", "q50", "q95"], ["point"])
    return rounded(out, "q05", "q50", "q95", "point")


def evaluate_members(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation of an ensemble: its members are averaged before anything is fitted."""
    return pipeline.evaluate_split(_members(spark, d), recalibrate=False)


def _sums(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read_table(spark, d, "embeddings").where("embedding is not null").select("vec_id", "label", R(total, 4).alias("s"))


def ood_near_far(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("label") < 8, "id").when(F.col("label") == 8, "near").otherwise("far")
    return rounded(abstain.ood_summary(_sums(spark, d).withColumn("kind", kind), "s", "kind"), "auroc", "aupr", "fpr95")


def station_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = _sums(spark, d)
    out = abstain.station_shift(rows.where("label < 8 and vec_id % 2 = 1"), rows.where("label >= 8"), "s")
    return rounded(out, "tau", "holdout_rate", "unseen_rate", "excess")


def mahalanobis_shift(spark: SparkSession, d: str) -> DataFrame:
    """The same with distances from what half of the known rows look like."""
    rows = read_table(spark, d, "embeddings").where("embedding is not null")
    fitted = abstain.fit_mahalanobis(rows.where("label < 8 and vec_id % 2 = 0"), "embedding")
    scored = rows.select("vec_id", "label", abstain.mahalanobis(F.col("embedding"), fitted).alias("s"))
    return rounded(abstain.station_shift(scored.where("label < 8 and vec_id % 2 = 1"), scored.where("label >= 8"), "s"), "tau", "holdout_rate", "unseen_rate", "excess")


def mahalanobis_inverse(spark: SparkSession, d: str) -> DataFrame:
    """(i, mean, inverse_ok): the fitted mean, and whether the precision undoes the shrunk covariance in each row."""
    import numpy as np

    rows = read_table(spark, d, "embeddings").where("label < 8")
    fitted = abstain.fit_mahalanobis(rows, "embedding")
    back = np.linalg.inv(fitted["precision"])
    width = len(fitted["mean"])
    spread = F.covar_pop("x", "y")
    long = rows.where("embedding is not null").select(F.posexplode("embedding").alias("i", "x"), F.col("embedding")).select("i", F.col("x").cast("double").alias("x"), F.posexplode("embedding").alias("j", "y"))
    cov = long.groupBy("i", "j").agg(spread.alias("c"))  # D x D rows
    mu, share = float(np.trace(back) / width), float(fitted["shrinkage"])
    told = spark.createDataFrame([(i, float(m), [float(v) for v in back[i]]) for i, m in enumerate(fitted["mean"])], "i int, mean double, row array<double>")
    want = (1 - share) * F.col("c") + F.when(F.col("i") == F.col("j"), share * mu).otherwise(0.0)
    good = F.bool_and(F.abs(F.get("row", F.col("j")) - want) < 1e-6 * mu)
    return cov.join(told, "i").groupBy("i").agg(F.round(F.max("mean"), 6).alias("mean"), good.alias("inverse_ok"))


def folder_find(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), F.lower(F.coalesce("quality", F.lit("none"))), F.lit("/"), F.coalesce("pm25_bin", F.lit("none")), F.lit("/"), F.col("filename"))
    rows = read_table(spark, d, "photos")
    tree = folder_rollup(rows.select(path.alias("path")))
    light = rows.groupBy(F.concat(F.lit("/data/"), F.lower(F.coalesce("quality", F.lit("none")))).alias("folder")).agg((F.avg("latitude") / 90).alias("brightness"))
    return find_folders(tree, {"root": ("data",), "levels": ("no such name",), "night": ("midnight",)}, {"levels": ("hazard", "moderate", "good", "unhealthy")}, 2, (), ("night", light, 2.0))


def five_channel_from_cache(spark: SparkSession, d: str) -> DataFrame:
    rows = pictures(spark, d)
    at = f"{shared_dir(spark)}/maps-{uuid.uuid4().hex}"
    build_map_cache(rows, at, size=8, patch=3)
    return five_channel_cached(rows, load_map_cache(spark, at), size=8)


def augmented_tensors(spark: SparkSession, d: str) -> DataFrame:
    return augmented(five_channel_table(pictures(spark, d), size=8, patch=3), size=8)


def transmission_correlation(spark: SparkSession, d: str) -> DataFrame:
    """The coefficients of `transmission_label_correlation` alone, which SQL can follow."""
    labels = read_table(spark, d, "embeddings").groupBy(F.call_function("div", "vec_id", F.lit(3)).alias("image")).agg(F.avg("label").alias("label"))
    both = mean_transmission(spark, d).join(labels, "image")
    return pipeline.label_correlation(both, "mean_t", "label", "image", n=None).select("n", R("pearson", 5).alias("pearson"), R("spearman", 5).alias("spearman"), "passes")


def p1_extended(spark: SparkSession, d: str) -> DataFrame:
    """(sensor_id, status, hours, values) with every sensor's series extended to the first and last hour of all
    sensors: how many hours of each status, and how many of them have a value."""
    timed = timed_readings(spark, d)
    hour = floor_div(F.col("utc_us"), HOUR_US)
    ends = timed.where("utc_us is not null").agg(F.min(hour).alias("a"), F.max(hour).alias("b")).first()
    grid = hourly_grid(timed, first_hour=ends["a"], last_hour=ends["b"])
    return grid.groupBy(F.col("source").alias("sensor_id"), "status").agg(F.count("*").alias("hours"), F.count("value").alias("values"))


QUERIES = {
    f.__name__: f
    for f in (
        aqi_colours, tta_mean, evaluate_members, ood_near_far, station_shift, mahalanobis_shift, mahalanobis_inverse, folder_find, five_channel_from_cache, augmented_tensors,
        transmission_correlation, p1_extended,
    )
}

_OOD = """select '{name}' as subset, n_id, n_ood, round(((select sum(r) from (select o, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from (select s, label >= 8 as o from s where {rows})) where o) - n_ood * (n_ood + 1) / 2.0) / (n_ood * n_id), 6) as auroc,
  round((select sum(pos * hits / seen::double) from (select pos, sum(c) over (order by s desc) as seen, sum(pos) over (order by s desc) as hits from (select s, count(*) as c, count(*) filter (where label >= 8) as pos from s where {rows} group by s))) / n_ood, 6) as aupr,
  round((select avg(case when s >= cut then 1.0 else 0 end) from s where label < 8), 6) as fpr95
from (select count(*) filter (where label < 8) as n_id, count(*) filter (where label >= 8) as n_ood, quantile_cont(s, 0.05) filter (where label >= 8) as cut from s where {rows})"""
_SUMS = "s as (select vec_id, label, round(list_sum(embedding)::double, 4) as s from embeddings where embedding is not null)"
_COLOUR = f"case {aqi.sql_category_index('pm25')} " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(("#00e400", "#ffff00", "#ff7e00", "#ff0000", "#8f3f97", "#7e0023"))) + " end"

SQL = {
    "aqi_colours": f"select {_COLOUR} as colour, count(*) as n from photos group by 1",
    "tta_mean": f"{MEMBERS_SQL} select row_id, round(q05, 6) as q05, round(q50, 6) as q50, round(q95, 6) as q95, round(point, 6) as point from avgd",
    "evaluate_members": f"""{MEMBERS_SQL}, e as (select greatest(q05 - y, y - q95) as e, row_number() over (order by greatest(q05 - y, y - q95)) as k, count(*) over () as n from avgd where split = 'cal'),
q as (select e as q from e where k = least(ceil((n + 1) * 0.9::double) + 1, n)),
wide as (select y, point as p, greatest(q05 - q, 0) as low, q95 + q as high from avgd, q where split = 'test')
select {_POINT_SQL}, round(avg(case when y >= low and y <= high then 1.0 else 0 end), 6) as coverage, round(avg(high - low), 6) as mean_width,
  round(avg(case when {aqi.sql_category_index('y')} = {aqi.sql_category_index('p')} then 1.0 else 0 end), 6) as category_accuracy,
  (select count(*) from avgd where split = 'train') as n_train, (select count(*) from avgd where split = 'test') as n_test, 0 as straddling from wide""",
    "ood_near_far": f"with {_SUMS} " + " union all ".join(_OOD.format(name=n, rows=r) for n, r in (("all", "true"), ("near", "label <= 8"), ("far", "label <> 8"))),
    "station_shift": f"""with {_SUMS}, h as (select s, row_number() over (order by s) as k, count(*) over () as n from s where label < 8 and vec_id % 2 = 1),
tau as (select s as tau from h where k = case when floor(0.05::double * n) <= 0 then n else n - floor(0.05::double * n) end),
r as (select tau, (select avg(case when s > tau then 1.0 else 0 end) from h) as a, (select avg(case when s > tau then 1.0 else 0 end) from s where label >= 8) as b from tau)
select round(tau, 6) as tau, round(a, 6) as holdout_rate, round(b, 6) as unseen_rate, round(b - a, 6) as excess from r""",
    "mahalanobis_inverse": """select i::int as i, round(avg(embedding[i + 1]::double), 6) as mean, true as inverse_ok
from embeddings, (select unnest(range((select max(len(embedding)) from embeddings))) as i) where label < 8 and embedding is not null group by 1""",
    "transmission_correlation": f"""{TRANSMISSION_SQL}, m as (select image, round(avg(t), 6) as t from tr group by 1), l as (select vec_id // 3 as image, avg(label) as y from embeddings group by 1),
r as (select t, y, rank() over (order by t) + (count(*) over (partition by t) - 1) / 2.0 as rt, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from m join l using (image))
select count(*) as n, round(round(corr(t, y), 6), 5) as pearson, round(round(corr(rt, ry), 6), 5) as spearman, corr(t, y) < 0 as passes from r""",
    "p1_extended": f"""with {hours_sql.TIMED_SQL}, {hours_sql._ONE}, {hours_sql._HOURS}, ends as (select min(h) as a, max(h) as b from hours),
{hours_sql._PAIRS}, g as (select sensor_id, nh - h - 1 as gap from pairs where nh - h > 1), span as (select sensor_id, min(h) as lo, max(h) as hi from hours group by 1)
select sensor_id, 'observed' as status, count(*) as hours, count(*) as values from hours group by 1
union all select sensor_id, 'filled', sum(gap)::bigint, sum(gap)::bigint from g where gap <= 6 group by 1
union all select sensor_id, 'gap', sum(gap)::bigint, 0 from g where gap > 6 group by 1
union all select sensor_id, 'outside', lo - a + b - hi, 0 from span, ends where lo - a + b - hi > 0""",
}
