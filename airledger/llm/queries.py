"""The queries of problems 2, 3, 5, 7, 8 and 9, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import with_instant
from ..operators.readings import DAY_US, floor_div, is_number
from ..session import write_between
from ..sources import read_table
from .lookalikes import canonical_texts, lookalike_pairs
from .overlap import cross_split_pairs, overlap_counts
from .packing import pack_all
from .percentiles import combine, percentiles, summarise
from .sql import SQL  # noqa: F401
from .splits import assign_components, linked_members, present_table, read_shares, split_name, station_number
from .tokenizer import VOCABULARIES, count_tokens, encode_column

QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def vocabulary(name: str) -> str:
    return os.path.join(os.environ.get("AIRLEDGER_VOCABULARIES", VOCABULARIES), f"{name}.tiktoken")


def _placed_values(spark: SparkSession, d: str) -> DataFrame:
    """(country, location_id, day, aqi) of the readings whose `aqi` is a number; the day is the UTC day
    of `date`, null where it names none; the country is the place's own, else the reading's."""
    places = read_table(spark, d, "locations")
    home = places.select(F.col("location_id").alias("__home"), F.col("country").alias("__home_country"))
    hourly = read_table(spark, d, "hourly")
    timed = with_instant(hourly.where(is_number(hourly["aqi"])), places)
    timed = timed.join(home, timed["location_id"] == home["__home"], "left")
    country = F.coalesce(F.col("__home_country"), F.upper(timed["country"]))
    return timed.select(country.alias("country"), timed["location_id"].alias("location_id"), floor_div(F.col("utc_us"), DAY_US).alias("day"), timed["aqi"].alias("aqi"))


def day_summaries(spark: SparkSession, d: str) -> DataFrame:
    """A summary of `aqi` for each country, location and day: the table that further days or files
    are combined with. It is written once."""
    return write_between(summarise(_placed_values(spark, d), ["country", "location_id", "day"], "aqi"), "summaries")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per location and day, per location and per country, each combined from the
    summaries of days. A null location, country or day is a key of its own."""
    days = day_summaries(spark, d)
    text = lambda c: F.col(c).cast("string")
    scope = lambda df, name, key, day: df.select(F.lit(name).alias("scope"), key.alias("key"), day.alias("day"), "n", *QUANTILES, "rank_error")
    none = F.lit(None).cast("date")
    places = combine(days, ["country", "location_id"])  # a step between days and countries, so that no task merges all days of all places
    by_day = percentiles(combine(days, ["location_id", "day"]), ["location_id", "day"], QUANTILES)
    by_location = percentiles(combine(places, ["location_id"]), ["location_id"], QUANTILES)
    by_country = percentiles(combine(places, ["country"]), ["country"], QUANTILES)
    return (
        scope(by_day, "location_day", text("location_id"), F.date_from_unix_date(F.col("day").cast("int")))
        .unionByName(scope(by_location, "location", text("location_id"), none))
        .unionByName(scope(by_country, "country", text("country"), none))
    )


def p2_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per location and day alone; exact for days of fewer values than a buffer holds."""
    keys = ["location_id", "day"]
    return percentiles(combine(day_summaries(spark, d), keys), keys, QUANTILES)


def p2_bounds(spark: SparkSession, d: str) -> DataFrame:
    """(scope, key, n, within): whether the true ranks of the percentiles per location and country are
    within their bounds, by counting all values on either side of each."""
    values = _placed_values(spark, d)
    places = combine(day_summaries(spark, d), ["country", "location_id"])
    out = None
    for scope, key in (("location", "location_id"), ("country", "country")):
        read = percentiles(combine(places, [key]), [key], QUANTILES).withColumnsRenamed({key: "key", "n": "total"})
        joined = values.join(read, values[key].eqNullSafe(read["key"]))
        counts = [c for q in QUANTILES for c in (F.count_if(F.col("aqi") < F.col(q)).alias(f"{q}_under"), F.count_if(F.col("aqi") <= F.col(q)).alias(f"{q}_upto"))]
        counted = joined.groupBy("key").agg(F.count("*").alias("n"), F.max("rank_error").alias("err"), F.max("total").alias("total"), *counts)
        good = F.col("n") == F.col("total")
        for q, p in QUANTILES.items():
            rank = F.ceil(F.lit(p) * F.col("n") - 1e-9)
            good = good & (F.col(f"{q}_under") + 1 - F.col("err") <= rank) & (rank <= F.col(f"{q}_upto") + F.col("err"))
        one = counted.select(F.lit(scope).alias("scope"), F.col("key").cast("string").alias("key"), "n", good.alias("within"))
        out = one if out is None else out.unionByName(one)
    return out


def p2_day_summaries(spark: SparkSession, d: str) -> DataFrame:
    return day_summaries(spark, d)


def _sp(spark: SparkSession, d: str) -> DataFrame:
    sp = read_table(spark, d, "sp")
    return sp.select("_row", "image_id", station_number(F.col("station_id")).alias("station_no"), split_name(F.col("split")).alias("split"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The stations that the operator quarantines when the present splits are its table."""
    sp = _sp(spark, d).where(F.col("station_no").isNotNull() & F.col("split").isNotNull())
    sizes = sp.groupBy(F.col("station_no").cast("string").alias("member")).agg(F.count("*").alias("n"))
    done = assign_components(sizes, read_shares(read_table(spark, d, "split_shares")), table=present_table(sp))
    return done.quarantined.select(F.col("member").cast("long").alias("station_no"))


def _member():
    return F.coalesce(F.concat(F.lit("station:"), F.col("station_no").cast("string")), F.concat(F.lit("row:"), F.col("_row").cast("string")))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """A split for every row of `sp`; a row without a station is kept with its copies only."""
    sp = _sp(spark, d).drop("split").withColumn("member", _member())
    sizes = sp.groupBy("member").agg(F.count("*").alias("n"))
    done = assign_components(sizes, read_shares(read_table(spark, d, "split_shares")))
    return sp.join(done.members.select("member", "component", "split"), "member").select("_row", "image_id", "station_no", "component", "split")


def p3_incremental(spark: SparkSession, d: str) -> DataFrame:
    """(station_no, component, split, status) after two runs: the first places the stations of the even
    rows and writes its table; the second reads that table, gets the stations of all rows and, as
    links, the stations that share a photo. Components keep their split, new ones fill what is
    lacking, and those that links bring together out of different splits are quarantined."""
    shares = read_shares(read_table(spark, d, "split_shares"))
    sp = write_between(_sp(spark, d).where(F.col("station_no").isNotNull()).select("_row", "image_id", F.col("station_no").cast("string").alias("member")), "stations")
    sizes = lambda df: df.groupBy("member").agg(F.count("*").alias("n"))
    table = write_between(assign_components(sizes(sp.where("_row % 2 = 0")), shares).members, "table")
    links = linked_members(sp, "image_id")
    done = assign_components(sizes(sp), shares, links=links, table=table).members
    return done.select(F.col("member").cast("long").alias("station_no"), "component", "split", "status")


def _photos(spark: SparkSession, d: str) -> DataFrame:
    """One row per photo and split that it stands in."""
    sp = _sp(spark, d).where(F.col("split").isNotNull()).select(F.col("_row").alias("row"), F.col("image_id").alias("sp_image"), "station_no", "split").distinct()
    groups = read_table(spark, d, "df_with_groups").select(F.col("_row").alias("row"), "image_id", "dup_group", "phash")
    return sp.join(groups, "row", "left").select("row", "split", "station_no", F.coalesce("image_id", "sp_image").alias("image_id"), "dup_group", "phash")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(_photos(spark, d)).select(F.col("a").alias("row_a"), F.col("b").alias("row_b"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap_counts(_photos(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(read_table(spark, d, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k"))


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    wanted: dict[str, list[tuple[str, int]]] = {}
    for r in read_table(spark, d, "pack_capacity").collect():  # three rows at every scale
        wanted.setdefault(r["tokenizer"], []).append((r["pack_name"], r["capacity"]))
    out = None
    for tokenizer, packs in wanted.items():
        sizes = count_tokens(read_table(spark, d, "documents"), "doc_id", "text", vocabulary(tokenizer))
        one = pack_all(sizes, packs)
        out = one if out is None else out.unionByName(one)
    return out


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """(pack_name, overfull, apart, broken, slack_ok): per capacity what must hold of any packing:
    no pack over its capacity, the parts of each text one after the other, only texts beyond the
    capacity divided, and no more packs than full ones and a hundredth more."""
    packs = write_between(p8_packs(spark, d), "packs")
    loads = packs.groupBy("pack_name", "capacity", "pack_id").agg(F.sum("n_tokens").alias("load"))
    held = loads.groupBy("pack_name", "capacity").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"), F.count_if(F.col("load") > 0).alias("used"), F.sum("load").alias("tokens"))
    texts = packs.groupBy("pack_name", "capacity", "doc_id").agg(
        F.count("*").alias("parts"), F.count_distinct("part").alias("different"), F.max("part").alias("last"), F.sum("n_tokens").alias("size"), F.max(F.col("start") + F.col("n_tokens")).alias("end"),
    )
    apart = (F.col("parts") != F.col("different")) | (F.col("last") != F.col("parts") - 1) | (F.col("end") != F.col("size"))
    told = texts.groupBy("pack_name").agg(F.count_if(apart).alias("apart"), F.count_if((F.col("parts") > 1) & (F.col("size") <= F.col("capacity"))).alias("broken"))
    slack = F.col("used") <= F.ceil(1.01 * F.col("tokens") / F.col("capacity")) + 1
    return held.join(told, "pack_name").select("pack_name", "overfull", "apart", "broken", slack.alias("slack_ok"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike_pairs(read_table(spark, d, "documents")).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical_texts(read_table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p2_percentiles, p2_day_percentiles, p2_bounds, p2_day_summaries, p3_found, p3_splits, p3_incremental, p5_found, p5_counts, p7_ids, p8_packs, p8_checks, p9_found, p9_canonical)
}

