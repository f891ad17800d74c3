"""Tables that the reference-style queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import drop_dead, keep_first, metadata
from ..operators.splits import SHARES
from ..sources import read_table

SEED = 42
DEAD_SQL = "camera_angle, quality_score, downloaded_at, filename, quality"


def photos(spark: SparkSession, d: str) -> DataFrame:
    """`photos` cleaned: dead columns dropped, the first row of each image."""
    return keep_first(drop_dead(metadata(read_table(spark, d, "photos"))))


def digit(key: Column) -> Column:
    """First hex digit of a key's fixed random number, as text."""
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{SEED}"))), 1, 1)


def _parts(d: Column) -> Column:
    return F.when(d < "a", "train").when(d < "c", "cal").otherwise("test")


def predictions(spark: SparkSession, d: str, leaky: bool = False) -> DataFrame:
    """A baseline model's outputs: (row_id, station_id, split, y, q05, q50, q95, point).

    Split by station (or, leaky, by row). The model is the distribution of the training
    labels in the photo's band of latitude, of all training labels where that band has none;
    leaky, the point is the mean of the station's training labels where it has any. Labels
    of the cal and test rows play no part in their own outputs.
    """
    rows = photos(spark, d).select(F.col("_row").alias("row_id"), "station_id", F.floor(F.col("latitude") / 15).cast("long").alias("zone"), F.col("pm25").alias("y"))
    rows = rows.withColumn("split", _parts(digit(F.col("row_id") if leaky else F.col("station_id"))))
    train = rows.where("split = 'train'")
    cut = [F.percentile("y", p).alias(f"q{round(100 * p):02d}") for p in (0.05, 0.5, 0.95)]
    zones = train.groupBy("zone").agg(*cut, F.avg("y").alias("zone_mean"))
    whole = train.agg(*(c.alias(f"all_{n}") for c, n in zip(cut, ("q05", "q50", "q95"))), F.avg("y").alias("all_mean"))
    out = rows.join(F.broadcast(zones), "zone", "left").join(F.broadcast(whole), how="cross")  # zones: at most 13 rows; whole: one
    point = F.coalesce("zone_mean", "all_mean")
    if leaky:
        stations = train.groupBy("station_id").agg(F.avg("y").alias("station_mean"))
        out = out.join(stations, "station_id", "left")
        point = F.coalesce(F.col("station_mean"), point)
    return out.select("row_id", "station_id", "split", "y", *(F.coalesce(q, f"all_{q}").alias(q) for q in ("q05", "q50", "q95")), point.alias("point"))


PHOTOS_SQL = f"""ph as (
  select * exclude ({DEAD_SQL}) from photos
  qualify row_number() over (partition by image_id order by _row) = 1)"""


def predictions_sql(leaky: bool = False, name: str = "pred") -> str:
    key = "_row" if leaky else "station_id"
    digit_sql = f"substr(md5(cast({key} as varchar) || '#{SEED}'), 1, 1)"
    point = "coalesce(z.m, w.m)" if not leaky else "coalesce(s.m, z.m, w.m)"
    join = f"left join (select station_id, avg(y) m from {name}_rows where split = 'train' group by 1) s using (station_id)" if leaky else ""
    return f"""{name}_rows as (
  select _row as row_id, station_id, cast(floor(latitude / 15) as bigint) as zone, pm25 as y,
         case when {digit_sql} < 'a' then 'train' when {digit_sql} < 'c' then 'cal' else 'test' end as split
  from ph),
{name}_zones as (select zone, quantile_cont(y, 0.05) q05, quantile_cont(y, 0.5) q50, quantile_cont(y, 0.95) q95, avg(y) m from {name}_rows where split = 'train' group by 1),
{name}_whole as (select quantile_cont(y, 0.05) q05, quantile_cont(y, 0.5) q50, quantile_cont(y, 0.95) q95, avg(y) m from {name}_rows where split = 'train'),
{name} as (
  select r.row_id, r.station_id, r.split, r.y, coalesce(z.q05, w.q05) q05, coalesce(z.q50, w.q50) q50, coalesce(z.q95, w.q95) q95, {point} as point
  from {name}_rows r left join {name}_zones z using (zone) cross join {name}_whole w {join})"""


def group_split_sql(source: str, shares: dict[str, float] | str, name: str = "placed", seed: int = SEED, held: str = "(select null::varchar as split, 0 as n)") -> str:
    """Recursive SQL of whole groups into shares, one group after the other: the largest goes first, each
    to the part that then lacks most, the first named on ties. Of groups of one size, those first
    in the fixed random order get the part named first.

    `source` is a relation (component, n); `shares` are numbers, or a relation (k, split, share);
    `held` (split, n) is what the parts have already.
    """
    if not isinstance(shares, str):
        shares = "(" + " union all ".join(f"select {k} as k, '{s}' as split, {x!r}::double as share" for k, (s, x) in enumerate(shares.items())) + ")"
    most = "list_position(lacks, list_max(lacks))"
    return f"""{name}_src as (select cast(component as varchar) component, n::bigint as n from {source}),
{name}_tot as (select (coalesce(sum(n), 0) + (select coalesce(sum(n), 0) from {held}))::double as total from {name}_src),
{name}_sh as (select any_value(total) as total, list(split order by k) as names, list(share order by k) as sh, sum(share order by k) as whole, list(coalesce(h.n, 0)::bigint order by k) as has from {shares} s left join {held} h using (split), {name}_tot),
{name}_order as (select component, n, row_number() over (order by n desc, component) as k from {name}_src),
{name}_walk as (
  select 0::bigint as k, 0::bigint as n, 0 as pick, list_transform(sh, lambda x, i: round_even(x / whole * total * 1000, 0)::bigint - 1000 * has[i]) as lacks from {name}_sh
  union all
  select b.k, b.n, {most}, list_transform(lacks, lambda x, i: case when i = {most} then x - b.n * 1000 else x end) from {name}_walk w join {name}_order b on b.k = w.k + 1),
{name}_picks as (select n, pick, row_number() over (partition by n order by pick) as nth from {name}_walk where k > 0),
{name}_ranked as (select component, n, row_number() over (partition by n order by md5(component || '#{seed}'), component) as nth from {name}_src),
{name} as (select r.component, r.n, names[p.pick] as split from {name}_ranked r join {name}_picks p using (n, nth), {name}_sh)"""


def shares() -> dict[str, float]:
    return dict(SHARES)
