"""Sensor feeds: JSON pages over HTTP or from a folder, and their relational parts."""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LOCATION_PAGE = "struct<results:array<struct<id:long,country:struct<code:string>,sensors:array<struct<id:long,parameter:struct<name:string>>>>>>"
HOUR_PAGE = "struct<results:array<struct<value:double,period:struct<datetimeFrom:struct<utc:string>>>>>"


def http_json(url: str, api_key: str, params: dict[str, object] | None = None, timeout: float = 60) -> dict:
    """The JSON behind a URL; raises on any status but success."""
    query = f"?{urllib.parse.urlencode(params)}" if params else ""
    request = urllib.request.Request(url + query, headers={"X-API-Key": api_key})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def parse_locations(pages: DataFrame, page: str = "page", body: str = "body", parameter: str = "pm25") -> DataFrame:
    """(page, pos, location_id, country, sensor_id): each place with its first sensor of the parameter."""
    rows = pages.select(page, F.posexplode(F.from_json(body, LOCATION_PAGE)["results"]).alias("pos", "place"))
    fits = F.filter(F.col("place.sensors"), lambda s: s["parameter"]["name"] == parameter)
    picked = rows.select(F.col(page).alias("page"), "pos", F.col("place.id").alias("location_id"), F.col("place.country.code").alias("country"), F.get(fits, 0)["id"].alias("sensor_id"))
    return picked.where(F.col("sensor_id").isNotNull())


def stratified_sensors(places: DataFrame, n: int = 80, per_country: int = 10, priority: tuple[str, ...] = (), priority_cap: int | None = None, order: tuple[str, ...] = ("page", "pos")) -> DataFrame:
    """The first places of each country up to its cap, of all those the first `n`.

    The caps hold before the limit: what a walk through the pages that stops at `n` would take.
    Places past their country's cap are cut in a windowed top-k that tasks apply to their own rows.
    """
    cap = F.when(F.col("country").isin(*priority), priority_cap or 2 * per_country).otherwise(per_country) if priority else F.lit(per_country)
    rank = F.row_number().over(Window.partitionBy("country").orderBy(*order))
    most = max(per_country, priority_cap or 2 * per_country)
    capped = places.withColumn("__k", rank).where(F.col("__k") <= most).where(F.col("__k") <= cap).drop("__k")
    return capped.orderBy(*order).limit(n)


def parse_hours(pages: DataFrame, key: str = "sensor_id", body: str = "body") -> DataFrame:
    """(key, datetime, value) of the readings that have a value and a time; a page that isn't JSON gives none."""
    rows = pages.select(key, F.explode(F.from_json(body, HOUR_PAGE)["results"]).alias("x"))
    return rows.select(key, F.col("x.period.datetimeFrom.utc").alias("datetime"), F.col("x.value").alias("value")).where("value is not null and datetime is not null")


def unreadable(pages: DataFrame, key: str = "sensor_id", body: str = "body") -> DataFrame:
    """(key, body) of the pages that hold no result list, to be looked at rather than lost."""
    parsed = F.from_json(F.col(body), HOUR_PAGE)
    return pages.where(parsed.isNull() | parsed["results"].isNull()).select(key, body)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pause = options["path"], float(options.get("pause", 0))

    def partitions(self) -> list[InputPartition]:
        return [_Part(os.path.join(self.root, f)) for f in sorted(os.listdir(self.root)) if f.endswith(".json")]

    def read(self, partition: _Part) -> Iterator[tuple[int | None, str, str | None]]:
        name = os.path.basename(partition.path)[: -len(".json")]
        try:
            with open(partition.path, encoding="utf-8") as f:
                body, error = f.read(), None
        except (OSError, UnicodeDecodeError) as why:
            body, error = "", str(why)
        if self.pause:
            time.sleep(self.pause)
        yield (int(name) if name.isdigit() else None), body, error


class SensorFeed(DataSource):
    """`spark.read.format("sensor_feed").load(folder)`: one saved answer a sensor, one partition
    each; an answer that can't be read becomes a row with its error, not a failure."""

    @classmethod
    def name(cls) -> str:
        return "sensor_feed"

    def schema(self) -> str:
        return "sensor_id long, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def folder_rollup(paths: DataFrame, path: str = "path") -> DataFrame:
    """(folder, files, direct): files below each folder at any depth, and right in it."""
    parts = F.split(F.regexp_replace(F.col(path), r"^[a-z]+:/*", "/"), "/")
    depth = F.size(parts)
    folders = F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rows = paths.select(F.posexplode(folders).alias("k", "folder"), (depth - 1).alias("d"))
    return rows.where("folder <> ''").groupBy("folder").agg(F.count("*").alias("files"), F.count_if(F.col("k") + 1 == F.col("d")).alias("direct"))


def match_folder(folder: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    """Name of the first kind one of whose keywords occurs in the folder's name, any case."""
    name = F.lower(F.element_at(F.split(folder, "/"), -1))
    out = F.lit(None).cast("string")
    for kind, words in reversed(list(keywords.items())):
        hit = F.lit(False)
        for word in words:
            hit = hit | name.contains(word)
        out = F.when(hit, kind).otherwise(out)
    return out


def find_folders(
    tree: DataFrame,
    keywords: dict[str, tuple[str, ...]],
    signatures: dict[str, tuple[str, ...]] | None = None,
    least_hits: int = 2,
    decoys: tuple[str, ...] = (),
    dark: tuple[str, DataFrame, float] | None = None,
) -> DataFrame:
    """(name, folder, found_by): the folder of each named set in a tree (folder, files) of `folder_rollup`.

    By `keyword`: one of the set's words stands in the folder's own name; the highest such
    folder, of those the one with most files. Else by `signature`: most of its subfolders,
    `least_hits` at least, are named by one of the set's words. Else, for the set named in `dark`,
    by `darkness`: the highest folder without any set's keyword whose mean brightness in the
    table (folder, brightness) lies under the limit. Paths with a decoy's word are left out;
    ties go to the first path. A set that isn't found has no row.
    """
    low = F.lower("folder")
    parts = F.split(low, "/")
    named = lambda words, column: reduce(lambda a, b: a | b, (column.contains(w) for w in words), F.lit(False))
    base = tree.where((F.col("files") > 0) & ~named(decoys, low)).select("folder", "files", F.element_at(parts, -1).alias("own"), F.size(parts).alias("depth"), F.regexp_replace("folder", "/[^/]*$", "").alias("parent"))
    out = None
    for name, words in keywords.items():
        by = [base.where(named(words, F.col("own"))).select(F.lit(0).alias("way"), F.lit("keyword").alias("found_by"), "folder", F.struct("depth", -F.col("files"), "folder").alias("order"))]
        if signatures and name in signatures:
            hits = tree.where(named(signatures[name], F.lower(F.element_at(F.split("folder", "/"), -1)))).select(F.regexp_replace("folder", "/[^/]*$", "").alias("parent")).groupBy("parent").agg(F.count("*").alias("hits"))
            kin = base.select("folder").join(hits.withColumnRenamed("parent", "folder"), "folder").where(F.col("hits") >= least_hits)
            by.append(kin.select(F.lit(1).alias("way"), F.lit("signature").alias("found_by"), "folder", F.struct((-F.col("hits")).cast("int").alias("depth"), F.lit(0).cast("long"), "folder").alias("order")))
        if dark and dark[0] == name:
            every = tuple(w for ws in keywords.values() for w in ws)
            dim = base.where(~named(every, F.col("own"))).join(dark[1].where(F.col("brightness") < dark[2]), "folder")
            by.append(dim.select(F.lit(2).alias("way"), F.lit("darkness").alias("found_by"), "folder", F.struct("depth", F.round(F.col("brightness") * 1e9).cast("long"), "folder").alias("order")))
        both = reduce(DataFrame.union, by)
        one = both.groupBy().agg(F.min_by(F.struct("folder", "found_by"), F.struct("way", "order")).alias("x")).where("x is not null").select(F.lit(name).alias("name"), "x.folder", "x.found_by")
        out = one if out is None else out.unionByName(one)
    return out
