"""Queries of the evaluation operators, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aqi
from ..functions.timestamps import with_instant
from ..operators import abstain, calibrate, ceiling, clean, duplicates, pipeline, scores, splits
from ..operators.ranks import md5_key, percentiles_by_key
from ..operators.readings import is_number
from ..session import shared_dir
from ..sources import read_table
from ..sources.feeds import folder_rollup, match_folder, parse_hours, stratified_sensors
from ..streaming.daily import daily_stream, run_available
from .general_sql import TIMED_SQL
from .views import PHOTOS_SQL, SEED, group_split_sql, photos, predictions, predictions_sql, shares

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


R = lambda c, k=6: F.round(c, k)
rounded = lambda df, *names: df.withColumns({n: F.round(n, 6) for n in names})

# index conversion


def _convert(convention: int) -> tuple[Query, str]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return read_table(spark, d, "hourly").select("reading_id", R(aqi.pm25_to_aqi(F.col("pm25_ugm3"), convention)).alias("index"))

    return run, f"select reading_id, round({aqi.sql_pm25_to_aqi('pm25_ugm3', convention)}, 6) as index from hourly"


for _c in (2012, 2024):
    QUERIES[f"aqi_convert_{_c}"], SQL[f"aqi_convert_{_c}"] = _convert(_c)


@query(f"select _row, round({aqi.sql_aqi_to_pm25('pm25')}, 6) as ugm3 from photos")
def aqi_inverse(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "photos").select("_row", R(aqi.aqi_to_pm25(F.col("pm25"))).alias("ugm3"))


@query(f"""select c as category_idx, case c {' '.join(f"when {i} then '{n}'" for i, (_, n) in enumerate(aqi.CATEGORIES))} end as category, count(*) as n
from (select {aqi.sql_category_index('pm25')} as c from photos) group by 1, 2""")
def aqi_category_hist(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "photos").select(aqi.category_index(F.col("pm25")).alias("category_idx"), aqi.category(F.col("pm25")).alias("category"))
    return rows.groupBy("category_idx", "category").agg(F.count("*").alias("n"))


# hourly readings



def hourly_sql(convention: int = 2012) -> str:
    return f"""{TIMED_SQL}, hc as (
  select location_id as station, cast(make_timestamp(utc_us) as date) as day, {aqi.sql_pm25_to_aqi('pm25_ugm3', convention)} as aqi
  from timed where location_id is not null and utc_us is not null and pm25_ugm3 >= 0 and pm25_ugm3 <= 1000 and not isnan(pm25_ugm3))"""


HOURLY_SQL = hourly_sql()
DAYS_SQL = """days as (
  select station, day, count(*) as n_hours, avg(aqi) as day_mean_aqi, var_samp(aqi) as within_day_var from hc group by 1, 2 having count(*) >= 18)"""
CURVE_SQL = f"""curve as (
  select {aqi.sql_band('day_mean_aqi')} as band_idx, count(*) as n_days, avg(within_day_var) as v from days where within_day_var is not null group by 1)"""
HIST_SQL = f"""hist as (
  select b.band_idx, count(l.b) / nullif((select count(*) from photos where pm25 is not null and not isnan(pm25) and not isinf(pm25)), 0)::double as p
  from (select unnest(range(6))::int as band_idx) b
  left join (select {aqi.sql_band('pm25')} as b from photos where pm25 is not null and not isnan(pm25) and not isinf(pm25)) l on l.b = b.band_idx group by 1)"""
FULL_SQL = """fit as (select greatest(coalesce(case when count(*) > 1 then regr_slope(v, band_idx) end, 0), 0) as slope, max(v) as v_max, max(band_idx) as top, arg_max(v, band_idx) as top_v from curve),
full_curve as (
  select h.band_idx, h.p, c.v is not null as covered,
         coalesce(c.v, case when h.band_idx > f.top then greatest(f.v_max, f.top_v + f.slope * (h.band_idx - f.top)) else f.v_max end) as v
  from hist h left join curve c using (band_idx) cross join fit f where h.p > 0)"""
NOISE_SQL = f"with {HOURLY_SQL}, {DAYS_SQL}, {CURVE_SQL}, {HIST_SQL}, {FULL_SQL}"


def _timed(spark: SparkSession, d: str, value: str = "pm25_ugm3", hourly: DataFrame | None = None) -> DataFrame:
    """The readings of `hourly` (or of a stream of it) whose `value` is a number, with the instant that `date` names as `at`."""
    rows = read_table(spark, d, "hourly") if hourly is None else hourly
    timed = with_instant(rows.where(is_number(F.col(value))), read_table(spark, d, "locations"))
    return timed.withColumn("at", F.timestamp_micros("utc_us"))


def _clean(spark: SparkSession, d: str, convention: int = 2012) -> DataFrame:
    return ceiling.clean_hourly(_timed(spark, d), time="at", convention=convention)


@query(f"with {HOURLY_SQL} select station, day, count(*) as n, round(sum(aqi), 4) as total from hc group by 1, 2")
def hourly_clean(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).groupBy("station", "day").agg(F.count("*").alias("n"), R(F.sum("aqi"), 4).alias("total"))


@query(f"with {HOURLY_SQL}, {DAYS_SQL} select station, day, n_hours, round(day_mean_aqi, 6) as day_mean_aqi, round(within_day_var, 4) as within_day_var from days")
def within_day_variance(spark: SparkSession, d: str) -> DataFrame:
    return ceiling.per_day(_clean(spark, d)).withColumns({"day_mean_aqi": R("day_mean_aqi"), "within_day_var": R("within_day_var", 4)})


@query(f"""with {HOURLY_SQL}, {DAYS_SQL}, dev as (select h.aqi - d.day_mean_aqi as e from hc h join days d using (station, day))
select count(*) as n, round(quantile_cont(e, 0.05), 4) as p05, round(quantile_cont(e, 0.5), 4) as p50, round(quantile_cont(e, 0.95), 4) as p95, round(quantile_cont(e, 0.95) - quantile_cont(e, 0.05), 4) as width from dev""")
def within_day_deviation_quantiles(spark: SparkSession, d: str) -> DataFrame:
    p = percentiles_by_key(ceiling.deviations(_clean(spark, d)), [], "deviation", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return p.select("n", R("p05", 4).alias("p05"), R("p50", 4).alias("p50"), R("p95", 4).alias("p95"), R(F.col("p95") - F.col("p05"), 4).alias("width"))


@query(f"with {HOURLY_SQL}, {DAYS_SQL}, {CURVE_SQL} select band_idx, n_days, round(v, 4) as v, round(sqrt(v), 5) as rmse_within_day from curve")
def noise_curve(spark: SparkSession, d: str) -> DataFrame:
    return ceiling.noise_curve(ceiling.per_day(_clean(spark, d))).select("band_idx", "n_days", R("v", 4).alias("v"), R("rmse_within_day", 5).alias("rmse_within_day"))


@query(f"with {HIST_SQL} select band_idx, round(p, 6) as p from hist")
def label_hist(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ceiling.label_hist(read_table(spark, d, "photos"), "pm25"), "p")


def _reweighted(spark: SparkSession, d: str, impute: bool) -> DataFrame:
    curve = ceiling.noise_curve(ceiling.per_day(_clean(spark, d)))
    out = ceiling.reweighted_variance(curve, ceiling.label_hist(read_table(spark, d, "photos"), "pm25"), impute)
    return out.select(R("var_epsilon", 4).alias("var_epsilon"), R("p_covered").alias("p_covered"))


@query(f"{NOISE_SQL} select round(sum(case when covered then p * v end) / sum(case when covered then p end), 4) as var_epsilon, round(coalesce(sum(case when covered then p end), 0), 6) as p_covered from full_curve")
def level_reweighted_var(spark: SparkSession, d: str) -> DataFrame:
    return _reweighted(spark, d, False)


@query(f"{NOISE_SQL} select round(sum(p * v) / sum(p), 4) as var_epsilon, round(coalesce(sum(case when covered then p end), 0), 6) as p_covered from full_curve")
def level_reweighted_var_conservative(spark: SparkSession, d: str) -> DataFrame:
    return _reweighted(spark, d, True)


@query(f"""{NOISE_SQL}, one as (
  select sum(case when covered then p * v end) / sum(case when covered then p end) as ve, sum(p * v) / sum(p) as vc, coalesce(sum(case when covered then p end), 0) as pc,
    (select var_pop(pm25) from photos where not isnan(pm25)) as vy from full_curve),
dev as (select quantile_cont(h.aqi - d.day_mean_aqi, 0.95) - quantile_cont(h.aqi - d.day_mean_aqi, 0.05) as w from hc h join days d using (station, day))
select round(ve, 4) as var_epsilon, round(vc, 4) as var_conservative, round(vy, 4) as var_labels, round(least(greatest(1 - ve / vy, 0), 1), 6) as r2_max,
  round(least(greatest(1 - vc / vy, 0), 1), 6) as r2_max_conservative, round(ve / vy, 6) as noise_fraction, round(w, 4) as interval_floor,
  round(2 * {ceiling.Z90!r}::double * sqrt(ve), 4) as interval_floor_normal, round(pc, 6) as p_covered, pc < 0.98 as optimistic from one, dev""")
def error_ceiling(spark: SparkSession, d: str) -> DataFrame:
    out = ceiling.error_ceiling(_clean(spark, d), read_table(spark, d, "photos"), "pm25")
    four = ("var_epsilon", "var_conservative", "var_labels", "interval_floor", "interval_floor_normal")
    return rounded(out.withColumns({c: R(c, 4) for c in four}), "r2_max", "r2_max_conservative", "noise_fraction", "p_covered")


@query(f"""{NOISE_SQL}, one as (select sum(case when covered then p * v end) / sum(case when covered then p end) as ve from full_curve)
select orig_split, round(var_pop(pm25), 4) as var_labels, round(least(greatest(1 - any_value(ve) / var_pop(pm25), 0), 1), 6) as r2_max from photos, one where orig_split is not null group by 1 having var_pop(pm25) > 0""")
def per_split_r2max(spark: SparkSession, d: str) -> DataFrame:
    labels = read_table(spark, d, "photos")
    eps = ceiling.reweighted_variance(ceiling.noise_curve(ceiling.per_day(_clean(spark, d))), ceiling.label_hist(labels, "pm25"))
    return ceiling.per_split_r2max(labels, "orig_split", "pm25", eps).select("orig_split", R("var_labels", 4).alias("var_labels"), R("r2_max").alias("r2_max"))


@query(f"""with {HOURLY_SQL}, {DAYS_SQL}, {HIST_SQL},
cells as (select station, {aqi.sql_band('day_mean_aqi')} as band_idx, sum(within_day_var) as s, count(within_day_var) as n from days group by 1, 2),
draws as (select *, (('0x' || substr(md5(cast(station as varchar) || '#' || cast(b as varchar) || '#0'), 1, 12))::bigint)::double / 281474976710656.0 as u from cells, (select unnest(range(1000)) as b)),
drawn as (select *, {'case ' + ' '.join(f'when u < {t!r}::double then {k}' for k, t in enumerate(ceiling.poisson_steps())) + ' else 8 end'} as times from draws),
per as (select b, band_idx, sum(s * times) / nullif(sum(n * times), 0) as v from drawn where times > 0 group by 1, 2),
eps as (select b, sum(p * v) / sum(p) as ve from per join hist using (band_idx) where p > 0 and v is not null group by 1),
r as (select least(greatest(1 - ve / (select var_pop(pm25) from photos), 0), 1) as r2 from eps)
select count(*) as n_boot, round(quantile_cont(r2, 0.5), 6) as median, round(quantile_cont(r2, 0.025), 6) as low, round(quantile_cont(r2, 0.975), 6) as high from r""")
def bootstrap_r2max(spark: SparkSession, d: str) -> DataFrame:
    labels = read_table(spark, d, "photos")
    out = ceiling.bootstrap_r2max(ceiling.per_day(_clean(spark, d)), ceiling.label_hist(labels, "pm25"), labels.agg(F.var_pop("pm25").alias("var_labels")))
    return rounded(out, "median", "low", "high")


# cleaning


@query(f"with {PHOTOS_SQL} select _row, image_id, station_id, captured_at, longitude, latitude, pm25, pm25_bin, orig_split from ph")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return photos(spark, d)


@query("select count(*) - count(distinct image_id) - max(case when image_id is null then 1 else 0 end) as n_duplicates_removed from photos")
def duplicates_removed(spark: SparkSession, d: str) -> DataFrame:
    return clean.duplicates_removed(read_table(spark, d, "photos"))


@query(f"with {PHOTOS_SQL} select _row, row_number() over (order by md5(cast(_row as varchar) || '|#{SEED}'), _row) - 1 as position from ph")
def shuffle_order(spark: SparkSession, d: str) -> DataFrame:
    return clean.shuffled(photos(spark, d).select("_row")).select("_row", "position")


@query(f"with {PHOTOS_SQL} select _row, pm25 from ph order by md5(cast(_row as varchar) || '|#{SEED}'), _row limit 500")
def exact_sample(spark: SparkSession, d: str) -> DataFrame:
    return clean.exact_sample(photos(spark, d), 500).select("_row", "pm25")


@query("select orig_split, count(*) as n, count(distinct station_id) as stations, round(avg(pm25), 6) as mean_label from photos group by 1")
def pooled_scan(spark: SparkSession, d: str) -> DataFrame:
    table = clean.metadata(read_table(spark, d, "photos"))
    parts = {name: table.where(F.col("orig_split") == name).drop("orig_split") for name in ("train", "test")}
    return clean.pooled(parts).groupBy("orig_split").agg(F.count("*").alias("n"), F.count_distinct("station_id").alias("stations"), R(F.avg("pm25")).alias("mean_label"))


@query("""with c as (select station_id, count(*) as n from photos where station_id is not null group by 1)
select count(*) as stations, min(n) as least, median(n) as middle, round(avg(n), 6) as mean, max(n) as most, floor(quantile_cont(n, 0.9))::bigint as p90, floor(quantile_cont(n, 0.99))::bigint as p99,
  round(100.0 * count(*) filter (where n = 1) / count(*), 4) as pct_singletons from c""")
def images_per_station(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "photos").where("station_id is not null").groupBy("station_id").agg(F.count("*").alias("n"))
    return c.agg(
        F.count("*").alias("stations"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("middle"), R(F.avg("n")).alias("mean"), F.max("n").alias("most"),
        F.percentile("n", 0.9).cast("long").alias("p90"), F.percentile("n", 0.99).cast("long").alias("p99"), R(F.try_divide(100.0 * F.count_if(F.col("n") == 1), F.count("*")), 4).alias("pct_singletons"),
    )


@query("select count(*) filter (where station_id is null) as station, count(*) filter (where latitude is null or longitude is null) as place, count(*) filter (where orig_split is null or orig_split not in ('train', 'test')) as orig_split from photos")
def input_guards(spark: SparkSession, d: str) -> DataFrame:
    return clean.violations(
        read_table(spark, d, "photos"), station=F.col("station_id").isNotNull(), place=F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), orig_split=F.col("orig_split").isin("train", "test")
    )


# splits

SIZES_SQL = f"{PHOTOS_SQL}, n as (select count(*) as n from ph)"


def _cut_sql(order: str) -> str:
    return f"""with {SIZES_SQL}, r as (select _row, row_number() over (order by {order}) as k from ph)
select _row, case when k <= round_even(0.65::double * n, 0) then 'train' when k <= round_even(0.65::double * n, 0) + round_even(0.15::double * n, 0) then 'cal' else 'test' end as split from r, n"""


@query(_cut_sql(f"md5(cast(_row as varchar) || '|#{SEED}'), _row"))
def split_random(spark: SparkSession, d: str) -> DataFrame:
    return splits.random_split(photos(spark, d)).select("_row", "split")


@query(_cut_sql("cast(captured_at as timestamp), _row"))
def split_temporal(spark: SparkSession, d: str) -> DataFrame:
    return splits.temporal_split(photos(spark, d)).select("_row", "split")


GROUPS_SQL = "(select station_id as component, count(*) as n from ph where station_id is not null group by 1)"
STATION_SQL = f"with recursive {PHOTOS_SQL}, {group_split_sql(GROUPS_SQL, shares())}"


@query(f"{STATION_SQL} select _row, split from ph join placed on cast(station_id as varchar) = component")
def split_station_grouped(spark: SparkSession, d: str) -> DataFrame:
    return splits.station_split(photos(spark, d)).select("_row", "split")


CELL_SQL = "cast(cast(floor(latitude / 10) * 10 as int) as varchar) || '_' || cast(cast(floor(longitude / 10) * 10 as int) as varchar)"


@query(f"with recursive {PHOTOS_SQL}, {group_split_sql(f'(select {CELL_SQL} as component, count(*) as n from ph group by 1)', shares())} select _row, split from ph join placed on {CELL_SQL} = component")
def split_geographic(spark: SparkSession, d: str) -> DataFrame:
    return splits.geographic_split(photos(spark, d)).select("_row", "split")


_WHOLE = 0.65 + 0.15
SHIPPED_SQL = "(select station_id as component, count(*) as n from ph where orig_split is distinct from 'test' group by 1)"


@query(f"""with recursive {PHOTOS_SQL}, {group_split_sql(SHIPPED_SQL, {"train": 0.65 / _WHOLE, "cal": 0.15 / _WHOLE})}
select _row, split from ph join placed on cast(station_id as varchar) = component where orig_split is distinct from 'test' union all select _row, 'test' from ph where orig_split = 'test'""")
def split_shipped(spark: SparkSession, d: str) -> DataFrame:
    return splits.shipped_split(photos(spark, d)).select("_row", "split")


@query(f"""{STATION_SQL}, s as (select station_id, split from ph join placed on cast(station_id as varchar) = component)
select {', '.join(f"count(*) filter (where split = '{s}') as n_{s}, round(count(*) filter (where split = '{s}') / count(*)::double, 3) as frac_{s}, count(distinct station_id) filter (where split = '{s}') as stations_{s}" for s in shares())},
  (select count(*) from (select station_id from s group by 1 having count(distinct split) > 1)) as straddling from s""")
def split_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(splits.station_split(photos(spark, d)))


@query("select station_id, count(distinct orig_split) as n_splits from photos where station_id is not null group by 1 having count(distinct orig_split) > 1")
def straddling_stations(spark: SparkSession, d: str) -> DataFrame:
    return splits.straddling(read_table(spark, d, "photos").withColumn("split", F.col("orig_split")))


def _folds_sql() -> str:
    ctes = [PHOTOS_SQL, group_split_sql(GROUPS_SQL, {str(k): 1 / 5 for k in range(5)}, "dealt")]
    parts = []
    for k in range(5):
        ctes.append(group_split_sql(f"(select component, n from dealt where split <> '{k}')", {"train": 1 - 0.1875, "cal": 0.1875}, f"f{k}", SEED + k))
        parts += [f"select {k} as fold, component as station_id, n, split as role from f{k}", f"select {k}, component, n, 'test' from dealt where split = '{k}'"]
    return f"with recursive {', '.join(ctes)} {' union all '.join(parts)}"


@query(_folds_sql())
def cv_folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.cv_folds(photos(spark, d))


@query(f"""with {PHOTOS_SQL}, b as (select _row, {aqi.sql_band('pm25')} as b from ph), c as (select b, count(*) as n from b group by 1)
select _row, round(1.0 / n, 9) as weight, round(sqrt(1.0 / n), 9) as root_weight from b join c on b.b is not distinct from c.b""")
def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    weighed = splits.balanced_weights(photos(spark, d), aqi.band(F.col("pm25")), 1.0)
    return weighed.select("_row", R("weight", 9).alias("weight"), R(F.sqrt("weight"), 9).alias("root_weight"))


@query(f"""with {PHOTOS_SQL}, b as (select _row, {aqi.sql_band('pm25')} as b from ph), c as (select b, count(*) as n from b group by 1),
w as (select _row, 1.0::double / n as w, sum(1.0::double / n) over (order by _row rows unbounded preceding) as upto from b join c on b.b is not distinct from c.b),
d as (select i as draw, (('0x' || substr(md5(cast(i as varchar) || '#{SEED}'), 1, 12))::bigint)::double / 281474976710656.0 * (select max(upto) from w) as pt from (select unnest(range((select count(*) from ph))) as i))
select draw, _row from d join w on pt >= upto - w and pt < upto""")
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = photos(spark, d)
    return splits.weighted_sample(splits.balanced_weights(rows, aqi.band(F.col("pm25")), 1.0), "weight", rows.count())


@query(f"""with {PHOTOS_SQL}, s as (select distinct station_id from ph where station_id is not null), r as (select station_id, row_number() over (order by md5(cast(station_id as varchar) || '|#{SEED}'), station_id) as k from s)
select station_id, case when k <= (select count(*) // 2 from s) then 'fit' else 'eval' end as part from r""")
def half_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.half_split(photos(spark, d))


# predictions and scores

PRED_SQL = f"with {PHOTOS_SQL}, {predictions_sql()}"
_POINT_SQL = """count(*) as n, round(avg(abs(p - y)), 6) as mae, round(sqrt(avg((p - y) * (p - y))), 6) as rmse, round(1 - sum((p - y) * (p - y)) / nullif(var_pop(y) * count(*), 0), 6) as r2,
  round(case when var_pop(p) > 1e-18 then pow(corr(y, p), 2) end, 6) as r2_pearson, round(stddev_pop(y), 6) as sd_y"""


@query(f"{PRED_SQL} select row_id, split, y, round(q05, 6) as q05, round(q50, 6) as q50, round(q95, 6) as q95, round(point, 6) as point from pred")
def baseline_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predictions(spark, d).drop("station_id"), "q05", "q50", "q95", "point")


@query(f"""{PRED_SQL}, e as (select greatest(q05 - y, y - q95) as e, row_number() over (order by greatest(q05 - y, y - q95)) as k, count(*) over () as n from pred where split = 'cal')
select n, round(e, 6) as q from e where k = least(ceil((n + 1) * 0.9::double) + 1, n)""")
def conformal_q(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibrate.conformal_q(predictions(spark, d).where("split = 'cal'"), "y", "q05", "q95"), "q")


CONF_SQL = f"""{PRED_SQL}, e as (select greatest(q05 - y, y - q95) as e, row_number() over (order by greatest(q05 - y, y - q95)) as k, count(*) over () as n from pred where split = 'cal'),
q as (select e as q from e where k = least(ceil((n + 1) * 0.9::double) + 1, n)),
wide as (select row_id, station_id, split, y, greatest(q05 - q, 0) as low, q50, q95 + q as high, point as p from pred, q where split = 'test')"""


def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    pred = predictions(spark, d)
    q = calibrate.conformal_q(pred.where("split = 'cal'"), "y", "q05", "q95")
    return calibrate.widen(pred.where("split = 'test'"), q, "q05", "q95")


@query(f"{CONF_SQL} select row_id, y, round(low, 6) as low, round(high, 6) as high from wide")
def conformal_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d).select("row_id", "y", R("q05").alias("low"), R("q95").alias("high"))


@query(f"{CONF_SQL} select count(*) as n, round(avg(case when y >= low and y <= high then 1.0 else 0 end), 6) as coverage, round(avg(high - low), 6) as mean_width from wide")
def interval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _calibrated(spark, d).agg(F.count("*").alias("n"), *scores.interval_scores(F.col("y"), F.col("q05"), F.col("q95")))


@query(f"{CONF_SQL} select {_POINT_SQL} from wide")
def point_metrics(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).where("split = 'test'").agg(*scores.point_scores(F.col("y"), F.col("point")))


@query(f"""{CONF_SQL} select {_POINT_SQL}, round(avg(case when y >= low and y <= high then 1.0 else 0 end), 6) as coverage, round(avg(high - low), 6) as mean_width,
round(avg(case when {aqi.sql_category_index('y')} = {aqi.sql_category_index('p')} then 1.0 else 0 end), 6) as category_accuracy from wide""")
def full_report(spark: SparkSession, d: str) -> DataFrame:
    return scores.full_report(_calibrated(spark, d), "y", "point", "q05", "q95")


@query(f"{CONF_SQL} select case {' '.join(f'when y >= {a} and y < {b} then {chr(39)}{a}-{b}{chr(39)}' for a, b in ((0, 50), (50, 100), (100, 150), (150, 200), (200, 300), (300, 10000)))} end as band, round(avg(abs(p - y)), 6) as mae, count(*) as n from wide where y >= 0 and y < 10000 group by 1")
def error_by_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return scores.error_by_band(predictions(spark, d).where("split = 'test'"), "y", "point")


@query(f"{CONF_SQL} select round(avg(case when {aqi.sql_category_index('y')} = {aqi.sql_category_index('p')} then 1.0 else 0 end), 6) as category_accuracy from wide")
def category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).where("split = 'test'").agg(scores.category_score(F.col("y"), F.col("point")))


@query(f"""{PRED_SQL} select count(*) as n, round(avg((greatest(0.05 * (y - q05), -0.95 * (y - q05)) + greatest(0.5 * (y - q50), -0.5 * (y - q50)) + greatest(0.95 * (y - q95), -0.05 * (y - q95))) / 3), 6) as pinball from pred where split = 'test'""")
def pinball_loss(spark: SparkSession, d: str) -> DataFrame:
    return scores.pinball(predictions(spark, d).where("split = 'test'"), "y", {"q05": 0.05, "q50": 0.5, "q95": 0.95})


LEAKY_SQL = f"with {PHOTOS_SQL}, {predictions_sql(True, 'leaky')}"


ISO_SQL = f"""{LEAKY_SQL}, pts as (select point as x, avg(y) as v, count(*)::double as w from leaky where split = 'cal' group by 1),
c as (select x, row_number() over (order by x) as k, sum(v * w) over (order by x rows unbounded preceding) as sv, sum(w) over (order by x rows unbounded preceding) as sw, v * w as own, w from pts),
avgs as (select i.k as i, j.k as j, (j.sv - i.sv + i.own) / (j.sw - i.sw + i.w) as a from c i join c j on j.k >= i.k),
mins as (select i, k, min(a) as low from avgs join (select k from c) on k >= i and j >= k group by 1, 2),
fit as (select x, greatest(max(low), 0) as f, lead(x) over (order by x) as nx, lead(greatest(max(low), 0)) over (order by x) as nf from mins join c using (k) group by 1)"""
_ISO_POINT = """case when point <= (select min(x) from fit) then (select arg_min(f, x) from fit) when point >= (select max(x) from fit) then (select arg_max(f, x) from fit)
  else (select f + (point - x) * (nf - f) / (nx - x) from fit where x <= point and nx > point) end"""
WIDE_SQL = f"""e as (select greatest(q05 - y, y - q95) as e, row_number() over (order by greatest(q05 - y, y - q95)) as k, count(*) over () as n from leaky where split = 'cal'),
q as (select e as q from e where k = least(ceil((n + 1) * 0.9::double) + 1, n)),
wide as (select row_id, y, {_ISO_POINT} as p, greatest(q05 - q, 0) as low, q95 + q as high from leaky, q where split = 'test')"""
_CATEGORY_SQL = f"case {aqi.sql_category_index('p')} " + " ".join(f"when {i} then '{n}'" for i, (_, n) in enumerate(aqi.CATEGORIES)) + " end"


@query(f"""{LEAKY_SQL}, t as (select y, point as p from leaky where split = 'test'),
r as (select y, p, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rp from t)
select count(*) as n, round(corr(y, p), 6) as pearson, round(corr(ry, rp), 6) as spearman from r""")
def spearman_pearson(spark: SparkSession, d: str) -> DataFrame:
    return scores.spearman(predictions(spark, d, leaky=True).where("split = 'test'"), "y", "point")


@query(f"""with {PHOTOS_SQL}, {predictions_sql()}, {predictions_sql(True, 'leaky')},
t as (select 'station' as strategy, y, point as p from pred where split = 'test' union all select 'random', y, point from leaky where split = 'test')
select strategy, {_POINT_SQL} from t group by 1""")
def leakage_gradient(spark: SparkSession, d: str) -> DataFrame:
    named = [predictions(spark, d, leaky).where("split = 'test'").select(F.lit(name).alias("strategy"), "y", "point") for name, leaky in (("station", False), ("random", True))]
    return named[0].unionByName(named[1]).groupBy("strategy").agg(*scores.point_scores(F.col("y"), F.col("point")))


@query(f"""{LEAKY_SQL}, g as (select l.*, dg.dup_group from leaky l left join df_with_groups dg on dg._row = l.row_id),
m as (select y, point as p, coalesce(station_id in (select station_id from g where split = 'train' and station_id is not null), false) or coalesce(dup_group in (select dup_group from g where split = 'train' and dup_group is not null), false) as contaminated from g where split = 'test'),
s as (select contaminated, {_POINT_SQL} from m group by 1)
select contaminated, n, round(n / (sum(n) over ())::double, 6) as share, case when n >= 5 then r2 end as r2, case when n >= 5 then mae end as mae, case when n >= 5 then rmse end as rmse, case when n >= 5 then sd_y end as sd_y from s""")
def contaminated_vs_clean(spark: SparkSession, d: str) -> DataFrame:
    groups = read_table(spark, d, "df_with_groups").select(F.col("_row").alias("row_id"), "dup_group")
    rows = predictions(spark, d, leaky=True).join(groups, "row_id", "left")
    marked = scores.contamination(rows.where("split = 'test'"), rows.where("split = 'train'"))
    return scores.contaminated_vs_clean(marked, "y", "point")


def _cv_sql() -> str:
    folds = _folds_sql().removeprefix("with recursive ")
    ctes, parts = folds.rsplit(" select 0 as fold", 1)
    return f"""with recursive {ctes}, fold as (select 0 as fold{parts}),
r as (select f.fold, f.role, cast(floor(p.latitude / 15) as bigint) as zone, p.pm25 as y from ph p join fold f on cast(p.station_id as varchar) = f.station_id),
m as (select fold, zone, avg(y) as p from r where role = 'train' group by 1, 2),
per as (select fold, {_POINT_SQL} from (select r.fold, y, p from r join m using (fold, zone) where role = 'test') group by 1),
long as (select unnest(['r2', 'r2_pearson', 'mae', 'rmse']) as metric, unnest([r2, r2_pearson, mae, rmse]) as v from per),
s as (select metric, avg(v) as m, stddev_samp(v) as sd, count(*) as k from long where v is not null group by 1)
select metric, round(m, 6) as mean, round(sd, 6) as sd, round(m - {_T4} * sd / sqrt(k), 6) as low, round(m + {_T4} * sd / sqrt(k), 6) as high,
  round(m - {_T4} * sd * sqrt(1.0 / k + 0.25), 6) as nb_low, round(m + {_T4} * sd * sqrt(1.0 / k + 0.25), 6) as nb_high from s"""


#: Fixed value: the 97.5 % point of Student's t with four degrees of freedom.
_T4 = 2.7764451051977987


@query(_cv_sql())
def cv_summary_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = photos(spark, d).select("station_id", F.floor(F.col("latitude") / 15).alias("zone"), F.col("pm25").alias("y"))
    fold = splits.cv_folds(rows).select(F.col("station_id").alias("s"), "fold", "role")
    placed = rows.join(fold, rows["station_id"].cast("string") == F.col("s"))
    model = placed.where("role = 'train'").groupBy("fold", "zone").agg(F.avg("y").alias("point"))
    tested = placed.where("role = 'test'").join(model, ["fold", "zone"])
    per = tested.groupBy("fold").agg(*scores.point_scores(F.col("y"), F.col("point")))
    return scores.summarise_folds(per, "fold", ["r2", "r2_pearson", "mae", "rmse"])


@query(f"""{LEAKY_SQL}, pts as (select point as x, avg(y) as v, count(*)::double as w from leaky where split = 'cal' group by 1),
c as (select x, row_number() over (order by x) as k, sum(v * w) over (order by x rows unbounded preceding) as sv, sum(w) over (order by x rows unbounded preceding) as sw, v * w as own, w from pts),
avgs as (select i.k as i, j.k as j, (j.sv - i.sv + i.own) / (j.sw - i.sw + i.w) as a from c i join c j on j.k >= i.k),
mins as (select i, k, min(a) as low from avgs join (select k from c) on k >= i and j >= k group by 1, 2),
fit as (select x, greatest(max(low), 0) as f from mins join c using (k) group by 1),
e as (select x, round(f, 6) as f, lag(round(f, 6)) over (order by x) as b, lead(round(f, 6)) over (order by x) as n from fit)
select round(x, 6) as x, f as fitted from e where b is null or n is null or b <> f or n <> f""")
def isotonic_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibrate.isotonic_fit(predictions(spark, d, leaky=True).where("split = 'cal'"), "point", "y"), "x", "fitted")


@query(f"""{ISO_SQL}, {WIDE_SQL}, g as (select *, ln(high) - ln(greatest(low, 1e-6)) > 3 as broad from wide)
select row_id, round(p, 4) as aqi, round(low, 4) as low, round(high, 4) as high, {_CATEGORY_SQL} as category, not broad as answer, case when broad then 'interval too wide' else 'ok' end as reason from g""")
def predict_batch(spark: SparkSession, d: str) -> DataFrame:
    """Serving: recalibrated point, interval, gate and category of every test row."""
    pred = predictions(spark, d, leaky=True)
    test = calibrate.apply_fit(pred.where("split = 'test'"), calibrate.isotonic_fit(pred.where("split = 'cal'"), "point", "y"), "point", "point")
    out = calibrate.widen(test, calibrate.conformal_q(pred.where("split = 'cal'"), "y", "q05", "q95"), "q05", "q95")
    width = abstain.log_width(F.greatest("q05", F.lit(1e-6)), F.col("q95"))
    gate = abstain.decide(F.lit(0.0), width, F.lit(0.5), F.lit(3.0), F.lit("out of distribution"))
    point = F.col("point")
    return out.select("row_id", R(point, 4).alias("aqi"), R("q05", 4).alias("low"), R("q95", 4).alias("high"), aqi.category(point).alias("category"), gate["answer"].alias("answer"), gate["reason"].alias("reason"))


@query(f"{PRED_SQL} select round(avg(y), 6) as y_mean, round(stddev_pop(y) + 1e-6, 6) as y_std from pred where split = 'train'")
def target_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibrate.target_stats(predictions(spark, d).where("split = 'train'"), "y"), "y_mean", "y_std")


# near-duplicates

PAIRS_SQL = "v as (select distinct phash as p from df_with_groups where phash is not null), pairs as (select a.p as a, b.p as b, bit_count(xor(a.p, b.p)) as distance from v a join v b on a.p < b.p and bit_count(xor(a.p, b.p)) <= 5)"
GROUPS_OF_SQL = f"""with recursive {PAIRS_SQL}, links as (select a, b from pairs union all select b, a from pairs),
reach as (select p as a, p as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a as p, min(b) as c from reach group by 1),
low as (select c, min(_row) as dup_group from df_with_groups join comp on phash = p group by 1),
grp as (select _row, coalesce(dup, _row) as dup_group from (select g._row, low.dup_group as dup from df_with_groups g left join comp on g.phash = comp.p left join low using (c)))"""


@query(f"with {PAIRS_SQL} select a as print_a, b as print_b, distance::int as distance from pairs")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_pairs(read_table(spark, d, "df_with_groups"))


@query(f"{GROUPS_OF_SQL} select _row, dup_group from grp")
def near_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.near_groups(read_table(spark, d, "df_with_groups"))


@query(f"""{GROUPS_OF_SQL}, s as (select dup_group, count(*) as n from grp group by 1)
select sum(n)::bigint as n_images, count(*) as n_groups, round(count(*) / sum(n)::double, 6) as distinct_ratio, max(n) as largest_group, count(*) filter (where n > 1) as n_multi_groups from s""")
def redundancy_report(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.redundancy_report(duplicates.near_groups(read_table(spark, d, "df_with_groups")))


# abstaining

UNSURE_SQL = f"{PRED_SQL}, u as (select row_id, split, y, point, ln(q95) - ln(q05) as u, abs(point - y) as e from pred)"


def _unsure(spark: SparkSession, d: str) -> DataFrame:
    pred = predictions(spark, d)
    return pred.withColumns({"u": abstain.log_width(F.col("q05"), F.col("q95")), "e": F.abs(F.col("point") - F.col("y"))})


@query(f"""{UNSURE_SQL}, r as (select e, row_number() over (order by e) as k, count(*) over () as n from u where split = 'cal')
select n, round(e, 6) as tau from r where k = case when floor(0.05::double * n) <= 0 then n else n - floor(0.05::double * n) end""")
def ood_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(abstain.ood_threshold(_unsure(spark, d).where("split = 'cal'"), "e"), "tau")


@query(f"{UNSURE_SQL} select round(quantile_cont(u, 0.9), 6) as tau from u where split = 'cal'")
def width_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(abstain.width_threshold(_unsure(spark, d).where("split = 'cal'"), "u"), "tau")


@query(f"""{UNSURE_SQL}, g as (select case when e > 60 then 'unlike the training data' when round(u, 9) > round((select quantile_cont(u, 0.8) from u where split = 'cal'), 9) then 'interval too wide' else 'ok' end as reason from u where split = 'test')
select reason = 'ok' as answer, reason, count(*) as n from g group by 1, 2""")
def abstain_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = _unsure(spark, d)
    tau = abstain.width_threshold(rows.where("split = 'cal'"), "u", 0.8)
    gated = rows.where("split = 'test'").join(F.broadcast(tau), how="cross")  # one row
    gate = abstain.decide(F.col("e"), R("u", 9), F.lit(60.0), R("tau", 9), F.lit("unlike the training data"))
    return gated.select(gate.alias("g")).groupBy("g.answer", "g.reason").agg(F.count("*").alias("n"))


CURVE_R_SQL = """c as (select row_id, row_number() over w as k, count(*) over () as n, sum(e) over (order by ru, row_id rows unbounded preceding) as s, sum(e) over (order by e, row_id rows unbounded preceding) as t,
  row_number() over (order by e, row_id) as kt from (select *, round(u, 9) as ru from u where split = 'test') window w as (order by ru, row_id))"""


@query(f"{UNSURE_SQL}, {CURVE_R_SQL} select row_id, k as rank, round(k / n::double, 6) as coverage, round(s / k, 5) as risk from c")
def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _unsure(spark, d).where("split = 'test'").withColumn("u", R("u", 9))
    return abstain.risk_coverage(rows, "u", "e", "row_id").select("row_id", "rank", R("coverage").alias("coverage"), R("risk", 5).alias("risk"))


@query(f"""{UNSURE_SQL}, {CURVE_R_SQL}
select count(*) as n, round(sum(s / k * case when k in (1, n) then 0.5 else 1 end) / max(n), 4) as aurc,
  round(sum(s / k * case when k in (1, n) then 0.5 else 1 end) / max(n) - sum(t / kt * case when kt in (1, n) then 0.5 else 1 end) / max(n), 4) as excess_aurc,
  round(sum(s / k * k / n * case when k in (1, n) then 0.5 else 1 end) / max(n), 4) as augrc from c""")
def aurc(spark: SparkSession, d: str) -> DataFrame:
    rows = _unsure(spark, d).where("split = 'test'").withColumn("u", R("u", 9))
    return abstain.risk_areas(rows, "u", "e", "row_id").withColumns({c: R(c, 4) for c in ("aurc", "excess_aurc", "augrc")})


@query(f"""{UNSURE_SQL}, r as (select y, point as p, row_number() over (order by round(u, 9), row_id) as k, count(*) over () as n from u where split = 'test')
select {_POINT_SQL} from r where k <= greatest(1, round_even(0.8::double * n, 0))""")
def selective_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _unsure(spark, d).where("split = 'test'").withColumn("u", R("u", 9))
    return abstain.most_confident(rows, "u", "row_id", 0.8).agg(*scores.point_scores(F.col("y"), F.col("point")))


EMB_SQL = "s as (select vec_id, label >= 8 as o, round(list_sum(embedding)::double, 4) as s from embeddings where embedding is not null)"


@query(f"""with {EMB_SQL}, r as (select o, s, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from s),
sizes as (select count(*) filter (where not o) as n_id, count(*) filter (where o) as n_ood, quantile_cont(s, 0.05) filter (where o) as cut from s),
lv as (select s, count(*) as c, count(*) filter (where o) as pos from s group by 1),
ap as (select sum(pos * hits / seen::double) as gain from (select pos, sum(c) over (order by s desc) as seen, sum(pos) over (order by s desc) as hits from lv))
select n_id, n_ood, round(((select sum(r) from r where o) - n_ood * (n_ood + 1) / 2.0) / (n_ood * n_id), 6) as auroc, round(gain / n_ood, 6) as aupr,
  round((select avg(case when s >= cut then 1.0 else 0 end) from s where not o), 6) as fpr95 from sizes, ap""")
def ood_auroc_ap_fpr95(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    rows = read_table(spark, d, "embeddings").where("embedding is not null").select(R(total, 4).alias("s"), (F.col("label") >= 8).alias("o"))
    return rounded(abstain.ood_metrics(rows, "s", "o"), "auroc", "aupr", "fpr95")


@query("""with q as (select * from embeddings where vec_id % 100 = 0), p as (select q.vec_id, list_distance(q.embedding, r.embedding) as x, row_number() over (partition by q.vec_id order by list_distance(q.embedding, r.embedding)) as k from q, embeddings r)
select vec_id, round(x::double, 4) as distance from p where k = 5""")
def knn_ood(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    return abstain.knn_distance(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding").select("vec_id", R("distance", 4).alias("distance"))


@query()
def mahalanobis_score(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    fitted = abstain.fit_mahalanobis(rows.where("label < 8"), "embedding")
    return rows.where("embedding is not null").select("vec_id", R(abstain.mahalanobis(F.col("embedding"), fitted)).alias("score"))


# feeds


@query("""with p as (select location_id, country, row_number() over (partition by country order by location_id) as k from locations)
select location_id, country from p where k <= case when country in ('IN', 'CN') then 20 else 10 end order by location_id limit 80""")
def sensor_topk_per_country(spark: SparkSession, d: str) -> DataFrame:
    places = read_table(spark, d, "locations").select("location_id", "country")
    return stratified_sensors(places, priority=("IN", "CN"), order=("location_id",))


@query("select event_type, count(*) as n, count(json_extract_string(props, '$.k')) as with_k from events group by 1")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))


@query("""with f as (select '/data/' || lower(coalesce(quality, 'none')) || '/' || coalesce(pm25_bin, 'none') || '/' || filename as path from photos),
s as (select string_split(path, '/') as parts from f), e as (select array_to_string(parts[1:k], '/') as folder, k + 1 = len(parts) as here from s, (select unnest(range(2, 5)) as k) where k < len(parts))
select folder, count(*) as files, count(*) filter (where here) as direct, case when contains(lower(string_split(folder, '/')[-1]), 'dark') then 'dark' when contains(lower(string_split(folder, '/')[-1]), 'blur') then 'blurred' end as kind from e group by folder""")
def folder_tree(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), F.lower(F.coalesce("quality", F.lit("none"))), F.lit("/"), F.coalesce("pm25_bin", F.lit("none")), F.lit("/"), F.col("filename"))
    tree = folder_rollup(read_table(spark, d, "photos").select(path.alias("path")))
    return tree.withColumn("kind", match_folder(F.col("folder"), {"dark": ("dark",), "blurred": ("blur",)}))




# whole evaluations


def _report_sql(name: str, source: str) -> str:
    parts = ", ".join(f"count(*) filter (where split = '{s}') as n_{s}, round(count(*) filter (where split = '{s}') / count(*)::double, 3) as frac_{s}, count(distinct station_id) filter (where split = '{s}') as stations_{s}" for s in shares())
    return f"select '{name}' as strategy, {parts}, (select count(*) from (select station_id from {source} where station_id is not null group by 1 having count(distinct split) > 1)) as straddling from {source}"


def _strategies_sql() -> str:
    cut = "case when k <= round_even(0.65::double * n, 0) then 'train' when k <= round_even(0.65::double * n, 0) + round_even(0.15::double * n, 0) then 'cal' else 'test' end"
    by_order = {"random": f"md5(cast(_row as varchar) || '|#{SEED}'), _row", "temporal": "cast(captured_at as timestamp), _row"}
    ctes = [PHOTOS_SQL, group_split_sql(GROUPS_SQL, shares(), "ps"), group_split_sql(f"(select {CELL_SQL} as component, count(*) as n from ph group by 1)", shares(), "pg")]
    ctes += ["station_grouped as (select station_id, split from ph join ps on cast(station_id as varchar) = component)", f"geographic as (select station_id, split from ph join pg on {CELL_SQL} = component)"]
    ctes += [f"{n} as (select station_id, {cut} as split from (select station_id, row_number() over (order by {o}) as k, count(*) over () as n from ph))" for n, o in by_order.items()]
    ctes += [group_split_sql(SHIPPED_SQL, {"train": 0.65 / _WHOLE, "cal": 0.15 / _WHOLE}, "pp"), """shipped as (select station_id, split from ph join pp on cast(station_id as varchar) = component where orig_split is distinct from 'test'
  union all select station_id, 'test' from ph where orig_split = 'test')"""]
    return f"with recursive {', '.join(ctes)} {' union all '.join(_report_sql(n, n) for n in ('station_grouped', 'random', 'geographic', 'temporal', 'shipped'))}"


@query(_strategies_sql())
def compare_strategies(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.compare_strategies(photos(spark, d))


@query(f"""{ISO_SQL}, {WIDE_SQL} select {_POINT_SQL}, round(avg(case when y >= low and y <= high then 1.0 else 0 end), 6) as coverage, round(avg(high - low), 6) as mean_width,
  round(avg(case when {aqi.sql_category_index('y')} = {aqi.sql_category_index('p')} then 1.0 else 0 end), 6) as category_accuracy,
  (select count(*) from leaky where split = 'train') as n_train, (select count(*) from leaky where split = 'test') as n_test,
  (select count(*) from (select station_id from leaky where station_id is not null group by 1 having count(distinct split) > 1)) as straddling from wide""")
def evaluate_split(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.evaluate_split(predictions(spark, d, leaky=True))


@query(f"""{PRED_SQL}, s as (select avg(y) as m, stddev_pop(y) + 1e-6 as sd from pred where split = 'train'),
l as (select ln(greatest(y, 1e-6)) as ly, ln(q05) as a, ln(q50) as b, ln(q95) as c, y, (point - m) / sd as z, m, sd from pred, s where split = 'test')
select round(avg((greatest(0.05 * (ly - a), -0.95 * (ly - a)) + greatest(0.5 * (ly - b), -0.5 * (ly - b)) + greatest(0.95 * (ly - c), -0.05 * (ly - c))) / 3) + avg(pow(z - (y - m) / sd, 2)), 6) as loss from l""")
def combined_loss(spark: SparkSession, d: str) -> DataFrame:
    pred = predictions(spark, d)
    stats = calibrate.target_stats(pred.where("split = 'train'"), "y").first()
    z = (F.col("point") - stats["y_mean"]) / stats["y_std"]
    logs = {q: (F.log(q), p) for q, p in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))}
    return pred.where("split = 'test'").agg(R(pipeline.combined_loss(F.col("y"), logs, z, stats["y_mean"], stats["y_std"])).alias("loss"))


@query(f"with {PHOTOS_SQL}, r as (select _row, pm25, row_number() over (order by pm25, _row) - 1 as k, greatest(1, count(*) over () // 40) as step from ph) select _row, pm25 from r where k % step = 0 and k < step * 40")
def every_kth(spark: SparkSession, d: str) -> DataFrame:
    """At most 40 photos along the whole range of labels: the step follows from the number of rows."""
    rows = photos(spark, d).select("_row", "pm25")
    return pipeline.every_kth(rows, [F.col("pm25"), F.col("_row")], max(1, rows.count() // 40), 40)


@query(f"""with {PHOTOS_SQL} {' union all '.join(f"(select '{n}' as target, _row, pm25 from ph order by abs(pm25 - {t}), _row limit 1)" for n, t in (("low", 20.0), ("middle", 80.0), ("high", 300.0)))}""")
def nearest_rows(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.nearest_rows(photos(spark, d), "pm25", {"low": 20.0, "middle": 80.0, "high": 300.0}, "_row")


@query(f"{CONF_SQL} select row_id, round((high - low) / 35, 5) as ratio, round((high - low) / 35, 9) <= 1.2 as near_floor from wide")
def interval_over_floor(spark: SparkSession, d: str) -> DataFrame:
    ratio, near = pipeline.width_over_floor(F.round("q05", 9), F.round("q95", 9))
    return _calibrated(spark, d).select("row_id", R(ratio, 5).alias("ratio"), near.alias("near_floor"))


@query(f"{UNSURE_SQL} select round(avg(case when e > 40 then 1.0 else 0 end), 6) as rate from u where split = 'test'")
def refuse_rate(spark: SparkSession, d: str) -> DataFrame:
    return _unsure(spark, d).where("split = 'test'").agg(R(abstain.refuse_rate(F.col("e"), F.lit(40.0))).alias("rate"))


# outputs of models


@query(f"""{ISO_SQL}, t as (select row_id, point from leaky where split = 'test')
select row_id, round(case when point <= (select min(x) from fit) then (select arg_min(f, x) from fit) when point >= (select max(x) from fit) then (select arg_max(f, x) from fit)
  else (select f + (point - x) * (nf - f) / (nx - x) from fit where x <= point and nx > point) end, 5) as point from t""")
def recalibrated_points(spark: SparkSession, d: str) -> DataFrame:
    pred = predictions(spark, d, leaky=True)
    fit = calibrate.isotonic_fit(pred.where("split = 'cal'"), "point", "y")
    return calibrate.apply_fit(pred.where("split = 'test'"), fit, "point", "iso").select("row_id", R("iso", 5).alias("point"))


@query(f"""with {PHOTOS_SQL}, {predictions_sql()}, {predictions_sql(True, 'leaky')},
m as (select row_id, q50 as a, point as b from pred union all select row_id, q50, point from leaky)
select row_id, round(exp(avg(ln(a))), 5) as q50, round(exp(avg(ln(b))), 5) as point from m group by 1""")
def ensemble_mean(spark: SparkSession, d: str) -> DataFrame:
    members = predictions(spark, d).unionByName(predictions(spark, d, leaky=True))
    return calibrate.ensemble_mean(members, "row_id", ["q50", "point"]).select("row_id", R("q50", 5).alias("q50"), R("point", 5).alias("point"))


@query(f"""{PRED_SQL}, s as (select avg(y) as m, stddev_pop(y) + 1e-6 as sd from pred where split = 'train')
select round(avg(abs(greatest((point - m) / sd * sd + m, 0) - y)), 6) as mae from pred, s where split = 'test'""")
def point_mae(spark: SparkSession, d: str) -> DataFrame:
    pred = predictions(spark, d)
    stats = calibrate.target_stats(pred.where("split = 'train'"), "y").first()
    back = calibrate.point_to_aqi((F.col("point") - stats["y_mean"]) / stats["y_std"], F.lit(stats["y_mean"]), F.lit(stats["y_std"]))
    return pred.where("split = 'test'").agg(R(F.avg(F.abs(back - F.col("y")))).alias("mae"))


@query("""with h as (select vec_id, embedding[1]::double as b, embedding[2]::double as s, embedding[3]::double as t from embeddings where len(embedding) >= 3)
select vec_id, round(b, 6) as q05, round(b + ln(1 + exp(s)), 6) as q50, round(b + ln(1 + exp(s)) + ln(1 + exp(t)), 6) as q95 from h""")
def monotone_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings").where("size(embedding) >= 3")
    head = [F.get("embedding", k).cast("double") for k in range(3)]
    return rows.select("vec_id", *(R(q).alias(n) for q, n in zip(calibrate.monotone_quantiles(head[0], head[1:]), ("q05", "q50", "q95"))))


@query("""select e::bigint as epoch, round(case when e < 2 then (e + 1) / 2.0 else 0.5 * (1 + cos(pi() * least((e - 2) / 58.0, 1))) end, 9) as factor from (select unnest(range(60)) as e)""")
def learning_rate(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(60).select(F.col("id").alias("epoch"), R(calibrate.cosine_warmup(F.col("id"), 2, 60), 9).alias("factor"))


@query(f"""with {TIMED_SQL} select sensor_id, strftime(make_timestamp(utc_us), '%Y-%m-%dT%H:%M:%S') || case when utc_us % 1000000 <> 0 then strftime(make_timestamp(utc_us), '.%f') else '' end || 'Z' as datetime, aqi as value
from timed where utc_us is not null and aqi is not null and not isnan(aqi)""")
def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Readings written as the pages of a feed and read back; each page has the instant that `date` names."""
    rows = _timed(spark, d, "aqi")
    fraction = F.when(F.pmod("utc_us", F.lit(1_000_000)) != 0, F.date_format("at", ".SSSSSS")).otherwise("")
    utc = F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
    one = F.struct(F.col("aqi").alias("value"), F.struct(F.struct(utc.alias("utc")).alias("datetimeFrom")).alias("period"))
    pages = rows.select("sensor_id", F.to_json(F.struct(F.array(one).alias("results"))).alias("body"))
    return parse_hours(pages)


@query(f"""with {HOURLY_SQL}, {DAYS_SQL}, last as (select max(make_timestamp(utc_us)) as t from timed where utc_us is not null and location_id is not null and pm25_ugm3 >= 0 and pm25_ugm3 <= 1000 and not isnan(pm25_ugm3))
select station, day, n_hours, round(day_mean_aqi, 6) as day_mean_aqi, round(within_day_var, 4) as within_day_var from days, last where day + interval 1 day <= t - interval 2 day""")
def streaming_daily(spark: SparkSession, d: str) -> DataFrame:
    """The per-day table from the stream of the readings' files, all there are in one batch: the days
    that were over two days before the last reading."""
    out = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(read_table(spark, d, "hourly").schema).parquet(f"{d}/hourly.parque[t]")  # a pattern, since one file is no folder
    run_available(daily_stream(_timed(spark, d, hourly=stream), time="at"), f"{out}/days", f"{out}/state")
    days = spark.read.schema("station long, day date, n_hours long, day_mean_aqi double, within_day_var double").parquet(f"{out}/days")
    return days.withColumns({"day_mean_aqi": R("day_mean_aqi"), "within_day_var": R("within_day_var", 4)})


# comparisons


def _convention_sql(convention: int) -> str:
    return f"""(with {hourly_sql(convention)}, {DAYS_SQL}, {CURVE_SQL}, {HIST_SQL}, {FULL_SQL}
select {convention} as convention, round(sum(case when covered then p * v end) / sum(case when covered then p end), 4) as var_epsilon,
  round(least(greatest(1 - sum(case when covered then p * v end) / sum(case when covered then p end) / (select var_pop(pm25) from photos where not isnan(pm25)), 0), 1), 6) as r2_max from full_curve)"""


@query(f"{_convention_sql(2012)} union all {_convention_sql(2024)}")
def ceiling_by_convention(spark: SparkSession, d: str) -> DataFrame:
    """How much the ceiling depends on the index convention."""
    out = None
    for convention in (2012, 2024):
        row = ceiling.error_ceiling(_clean(spark, d, convention), read_table(spark, d, "photos"), "pm25").select(F.lit(convention).alias("convention"), R("var_epsilon", 4).alias("var_epsilon"), R("r2_max").alias("r2_max"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""{UNSURE_SQL}, t as (select row_id, e, round(u, 9) as width, e as oracle, md5(cast(row_id as varchar) || '|#{SEED}') as m from u where split = 'test'),
c as (select 'width' as signal, e, row_number() over (order by width, row_id) as k from t union all select 'oracle', e, row_number() over (order by oracle, row_id) from t union all select 'random', e, row_number() over (order by m, row_id) from t),
r as (select signal, k, count(*) over (partition by signal) as n, sum(e) over (partition by signal order by k rows unbounded preceding) / k as risk from c)
select signal, round(sum(risk * case when k in (1, n) then 0.5 else 1 end) / max(n), 4) as aurc from r group by 1""")
def aurc_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Area under risk against coverage of the interval width, of a random order and of the error itself."""
    rows = _unsure(spark, d).where("split = 'test'")
    signals = {"width": R("u", 9), "oracle": F.col("e"), "random": F.conv(F.substring(md5_key(F.col("row_id")), 1, 15), 16, 10).cast("double")}
    out = None
    for name, signal in signals.items():
        one = abstain.risk_areas(rows.withColumn("signal", signal), "signal", "e", "row_id").select(F.lit(name).alias("signal"), R("aurc", 4).alias("aurc"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with {PHOTOS_SQL}, {predictions_sql()}, {predictions_sql(True, 'leaky')},
a as (select {_POINT_SQL} from (select y, point as p from pred where split = 'test')), b as (select {_POINT_SQL} from (select y, point as p from leaky where split = 'test'))
select round(a.mae - b.mae, 5) as delta_mae, round(b.r2 - a.r2, 5) as delta_r2 from a, b""")
def leakage_deltas(spark: SparkSession, d: str) -> DataFrame:
    """How much better a leaky split looks than a safe one."""
    rows = leakage_gradient(spark, d)
    at = lambda s, c: F.max(F.when(F.col("strategy") == s, F.col(c)))
    return rows.agg(R(at("station", "mae") - at("random", "mae"), 5).alias("delta_mae"), R(at("random", "r2") - at("station", "r2"), 5).alias("delta_r2"))


@query(f"""{ISO_SQL}, t as (select y, point, case when point <= (select min(x) from fit) then (select arg_min(f, x) from fit) when point >= (select max(x) from fit) then (select arg_max(f, x) from fit)
  else (select f + (point - x) * (nf - f) / (nx - x) from fit where x <= point and nx > point) end as iso from leaky where split = 'test'),
u as (select 'raw' as point, y, point as p from t union all select 'recalibrated', y, iso from t)
select point, {_POINT_SQL} from u group by 1""")
def recalibration_report(spark: SparkSession, d: str) -> DataFrame:
    pred = predictions(spark, d, leaky=True)
    fit = calibrate.isotonic_fit(pred.where("split = 'cal'"), "point", "y")
    test = calibrate.apply_fit(pred.where("split = 'test'"), fit, "point", "iso")
    both = test.select(F.explode(F.array(*(F.struct(F.lit(n).alias("point"), F.col("y"), F.col(c).alias("p")) for n, c in (("raw", "point"), ("recalibrated", "iso"))))).alias("x")).select("x.*")
    return both.groupBy("point").agg(*scores.point_scores(F.col("y"), F.col("p")))


@query(f"""{CONF_SQL} select 'raw' as intervals, round(avg(case when y >= q05 and y <= q95 then 1.0 else 0 end), 6) as coverage, round(avg(q95 - q05), 6) as mean_width from pred where split = 'test'
union all select 'calibrated', round(avg(case when y >= low and y <= high then 1.0 else 0 end), 6), round(avg(high - low), 6) from wide""")
def coverage_before_after(spark: SparkSession, d: str) -> DataFrame:
    raw = predictions(spark, d).where("split = 'test'")
    named = [df.select(F.lit(n).alias("intervals"), "y", "q05", "q95") for n, df in (("raw", raw), ("calibrated", _calibrated(spark, d)))]
    return named[0].unionByName(named[1]).groupBy("intervals").agg(*scores.interval_scores(F.col("y"), F.col("q05"), F.col("q95")))
