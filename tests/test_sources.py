import json

import pytest
from pyspark.sql import functions as F

from airledger.operators.ceiling import clean_hourly, per_day
from airledger.sources.bundle import load_bundle, save_bundle, write_report
from airledger.sources.feeds import SensorFeed, folder_rollup, match_folder, parse_hours, parse_locations, stratified_sensors, unreadable
from airledger.streaming.daily import daily_stream, run_available


def test_feed(spark, tmp_path):
    page = {"results": [{"value": 5.0, "period": {"datetimeFrom": {"utc": "2024-01-01T00:00:00Z"}}}, {"value": None, "period": {"datetimeFrom": {"utc": "2024-01-01T01:00:00Z"}}}, {"value": 7.0, "period": None}]}
    (tmp_path / "11.json").write_text(json.dumps(page))
    (tmp_path / "12.json").write_text("{broken")
    (tmp_path / "13.json").write_bytes(b"\xff\xfe")
    (tmp_path / "notes.txt").write_text("x")
    spark.dataSource.register(SensorFeed)
    pages = spark.read.format("sensor_feed").load(str(tmp_path))
    assert pages.count() == 3
    assert [tuple(r) for r in parse_hours(pages).collect()] == [(11, "2024-01-01T00:00:00Z", 5.0)]
    assert {r["sensor_id"] for r in unreadable(pages).collect()} == {12, 13}
    assert pages.where("error is not null").first()["sensor_id"] == 13


def test_sensor_choice(spark):
    places = [{"id": 10 * p + k, "country": {"code": "IN" if k < 6 else "DE"}, "sensors": [{"id": 1000 + 10 * p + k, "parameter": {"name": "pm25" if k != 8 else "o3"}}]} for p in range(3) for k in range(10)]
    pages = spark.createDataFrame([(p, json.dumps({"results": places[10 * p : 10 * p + 10]})) for p in range(3)] + [(3, json.dumps({"results": []}))], "page int, body string")
    found = parse_locations(pages)
    assert found.count() == 27 and found.where("country = 'DE'").count() == 9
    want, per = [], {}
    for p in places:
        c, ok = p["country"]["code"], p["sensors"][0]["parameter"]["name"] == "pm25"
        if ok and per.get(c, 0) < (8 if c == "IN" else 4) and len(want) < 11:
            per[c] = per.get(c, 0) + 1
            want.append(p["id"])
    got = [r["location_id"] for r in stratified_sensors(found, n=11, per_country=4, priority=("IN",)).collect()]
    assert got == want


def test_folders(spark):
    paths = spark.createDataFrame([("file:/a/b/x.jpg",), ("file:/a/b/y.jpg",), ("file:/a/z.jpg",), ("/a/DarkOnes/w.jpg",)], "path string")
    got = {r["folder"]: (r["files"], r["direct"]) for r in folder_rollup(paths).collect()}
    assert got == {"/a": (4, 1), "/a/b": (2, 2), "/a/DarkOnes": (1, 1)}
    kinds = folder_rollup(paths).withColumn("kind", match_folder(F.col("folder"), {"dark": ("dark",)})).where("kind is not null").collect()
    assert [r["folder"] for r in kinds] == ["/a/DarkOnes"]


def test_bundle_and_reports(spark, tmp_path):
    values = {"q": 30.0, "y_mean": 100.0, "y_std": 50.0, "tau_ood": 0.5, "tau_width": 3.0, "knots": [[1.0, 2.0], [3.0, 4.0]]}
    save_bundle(spark, str(tmp_path / "b"), **values)
    assert load_bundle(spark, str(tmp_path / "b")) == values | {"handcrafted_tau": 0.5}
    with pytest.raises(ValueError):
        save_bundle(spark, str(tmp_path / "c"), q=1.0)
    df = spark.createDataFrame([(1, 0.5)], "fold int, r2 double")
    for form in ("csv", "json"):
        write_report(df, str(tmp_path / form), form)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["r2"] == "0.5"
    assert spark.read.json(str(tmp_path / "json")).first()["fold"] == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, f"2024-01-{d:02d}T{h:02d}:00:00Z", float(5 + h + 3 * d + s)) for s in range(3) for d in range(1, 8) for h in range(24) if (s, d) != (2, 3) or h < 5]
    rows += [(1, "junk", 5.0), (1, "2024-01-02T00:30:00Z", -5.0), (None, "2024-01-02T00:30:00Z", 5.0)]
    schema = "location_id long, datetime string, pm25_ugm3 double"
    spark.createDataFrame(rows, schema).repartition(1).sortWithinPartitions("datetime").write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, "2024-03-01T00:00:00Z", 1.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_available(daily_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    key = lambda df: {(r["station"], str(r["day"]), r["n_hours"], round(r["day_mean_aqi"], 6), round(r["within_day_var"], 6)) for r in df.collect()}
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(per_day(clean_hourly(spark.createDataFrame(rows, schema))))


def png(rgb):
    """A PNG file from rows of RGB bytes."""
    import struct
    import zlib

    h, w = len(rgb), len(rgb[0])
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def test_pictures_from_files(spark, tmp_path):
    from airledger.sources.images import build_map_cache, iter_pictures, load_map_cache, pixel_table, read_pictures, verify_map_cache

    rows = [[(10 * x, 20 * y, 200) for x in range(6)] for y in range(5)]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.png").write_bytes(png(rows))
    (tmp_path / "in" / "deep" / "b.png").write_bytes(png([[(255, 0, 0)] * 4] * 4))
    (tmp_path / "in" / "c.png").write_bytes(b"no picture")
    pictures = read_pictures(spark, str(tmp_path / "in"))
    got = {k.rsplit("/", 1)[1]: v for k, v in iter_pictures(pictures)}
    assert set(got) == {"a.png", "b.png"} and got["a.png"].shape == (5, 6, 3)
    assert abs(got["a.png"] * 255 - rows).max() < 1e-9
    first = pixel_table(pictures).where("image like '%a.png' and y = 3 and x = 2").first()
    assert [round(first[c] * 255) for c in "rgb"] == [20, 60, 200]
    build_map_cache(pictures, str(tmp_path / "maps"), size=16, patch=3)
    cached = load_map_cache(spark, str(tmp_path / "maps"))
    assert verify_map_cache(cached, pictures, size=16, patch=3)["checked"] == 2
    images = [r["image"] for r in cached.orderBy("image").collect()]
    swapped = cached.withColumn("image", F.when(F.col("image") == images[0], images[1]).otherwise(images[0]))
    with pytest.raises(AssertionError):
        verify_map_cache(swapped, pictures, size=16, patch=3)


def test_config(tmp_path):
    from airledger.config import find_config, load_config

    assert load_config(None).split.train == 0.65
    (tmp_path / "airledger.yaml").write_text("seed: 7\nsplit: {train: 0.5}\n")
    (tmp_path / "sub").mkdir()
    found = load_config(find_config(tmp_path / "sub"))
    assert (found.seed, found.split.train, found.split.cal) == (7, 0.5, 0.15)
    with pytest.raises(AttributeError):
        found.nothing


def test_http(tmp_path):
    import threading
    import urllib.error
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from airledger.sources.feeds import http_json

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            good = self.headers["X-API-Key"] == "key" and self.path == "/v?page=2"
            self.send_response(200 if good else 403)
            self.end_headers()
            self.wfile.write(b'{"results": []}')

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v"
    assert http_json(url, "key", {"page": 2}) == {"results": []}
    with pytest.raises(urllib.error.HTTPError):
        http_json(url, "other", {"page": 2})
    server.shutdown()
