import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from airledger.functions.timestamps import LONGEST, parse_times, with_instant
from airledger.functions.zones import parse_tzif, zone_table
from airledger.plans import general

BERLIN, NEPAL, DENVER, LORD_HOWE = "Europe/Berlin", "Asia/Kathmandu", "America/Denver", "Australia/Lord_Howe"


def parse(texts, zone=BERLIN, order="dmy"):
    n = len(texts)
    zones = zone if isinstance(zone, list) else [zone] * n
    return parse_times(pa.array(texts, pa.string()), pa.array(zones, pa.string()), pa.array([order] * n, pa.string()), zone_table()).to_pylist()


def us(text):
    return int((np.datetime64(text, "us") - np.datetime64("1970-01-01", "us")).astype(int))


GOOD = [
    ("2024-05-01T07:00:00Z", "2024-05-01T07:00:00"), ("2024-05-01t07:00:00z", "2024-05-01T07:00:00"), ("  2024-05-01T07:00:00Z ", "2024-05-01T07:00:00"),
    ("2024-05-01T07:00:00.5Z", "2024-05-01T07:00:00.5"), ("2024-05-01T07:00:00,123456Z", "2024-05-01T07:00:00.123456"), ("20240501T070000Z", "2024-05-01T07:00:00"),
    ("1714546800", "2024-05-01T07:00:00"), ("1714546800123", "2024-05-01T07:00:00.123"), ("1714546800123456", "2024-05-01T07:00:00.123456"),
    ("2024-05-01T07:00:00+02:00", "2024-05-01T05:00:00"), ("2024-05-01T07:00+0530", "2024-05-01T01:30:00"), ("2024-05-01T07:00:00-03", "2024-05-01T10:00:00"),
    ("2024-05-01T07:00:00+02:00[Europe/Berlin]", "2024-05-01T05:00:00"), ("2024-05-01 07:00:00 Asia/Kathmandu", "2024-05-01T01:15:00"), ("2024-05-01 07:00:00 CEST", "2024-05-01T05:00:00"),
    ("2024-05-01 07:00:00 CET", "2024-05-01T06:00:00"), ("2024-122T07:00:00Z", "2024-05-01T07:00:00"), ("01.05.2024 09:00:00", "2024-05-01T07:00:00"), ("1/5/2024 9:00:00 AM", "2024-05-01T07:00:00"),
    ("1/5/2024 12:00:00 PM", "2024-05-01T10:00:00"), ("1/5/2024 12:00:00 AM", "2024-04-30T22:00:00"), ("Wed, 01 May 2024 07:00:00 GMT", "2024-05-01T07:00:00"), ("01-May-2024 07:00:00 UTC", "2024-05-01T07:00:00"),
    ("1 May 2024, 09:00", "2024-05-01T07:00:00"), ("20240501090000", "2024-05-01T07:00:00"), ("2024/5/1 09:00:00", "2024-05-01T07:00:00"), ("2024.05.01 09:00:00", "2024-05-01T07:00:00"), ("2024-02-29 00:30", "2024-02-28T23:30:00"),
    ("2024-10-27 02:30:00", "2024-10-27T00:30:00"), ("2024-10-27 02:30:00 CET", "2024-10-27T01:30:00"), ("2050-07-01 12:00:00", "2050-07-01T10:00:00"), ("1969-12-31T23:59:59.000001Z", "1969-12-31T23:59:59.000001"),
]
BAD = [
    None, "", " ", "--", "n/a", "pending", "25:61", "1899-99-99", "0000-00-00 00:00:00", "2024-02-30 10:00:00", "2023-02-29T04:00:00Z", "2024-13-05T08:00:00Z", "31/31/2024 07:15", "2024-05-01T24:00:00Z", "2024-05-01T07:60:00Z",
    "2024-366x", "2023-366T00:00:00Z", "Thu, 01 May 2024 07:00:00 GMT", "2024-05-01 07:00:00 XYZ", "2024-05-01 07:00:00 Nowhere/Land", "13/5/2024 13:00:00 PM", "2024-03-31 02:30:00", "x" * (LONGEST + 1), "1" * 5000, "２０２４-05-01T07:00:00Z", "2024-05-01X07:00:00Z",
]


@pytest.mark.parametrize("text, want", GOOD)
def test_good(text, want):
    assert parse([text]) == [us(want)]


def test_bad_and_together():
    assert parse(BAD) == [None] * len(BAD)
    mixed = [t for pair in zip([g for g, _ in GOOD], BAD) for t in pair]
    want = [x for pair in zip([us(w) for _, w in GOOD], [None] * len(BAD)) for x in pair]
    assert parse(mixed) == want


def test_order_and_missing_place():
    assert parse(["1/5/2024 09:00:00"], DENVER, "mdy") == [us("2024-01-05T16:00:00")]
    assert parse(["1/5/2024 09:00:00"], BERLIN, "ymd") == [None]
    assert parse(["2024-05-01 07:00:00", "2024-05-01 07:00:00 UTC", "1/5/2024 07:00:00"], [None] * 3, None) == [None, us("2024-05-01T07:00:00"), None]
    assert parse(["2024-05-01 07:00:00 IST", "2024-05-01 07:00:00 CST"], ["Asia/Kolkata", "Asia/Shanghai"]) == [us("2024-05-01T01:30:00"), us("2024-04-30T23:00:00")]
    assert parse(["2024-05-01 07:00:00 IST"], BERLIN) == [None]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([BERLIN, NEPAL, DENVER, LORD_HOWE, "America/Sao_Paulo", "Africa/Lagos"]), st.datetimes(min_value=__import__("datetime").datetime(1995, 1, 1), max_value=__import__("datetime").datetime(2090, 1, 1)))
def test_wall_clocks_like_zoneinfo(zone, wall):
    wall = wall.replace(microsecond=0)
    want = brute.shown(wall, zone)
    got = parse([wall.strftime("%Y-%m-%d %H:%M:%S")], zone)[0]
    assert got == (None if want is None else int(want.timestamp()) * 10**6)


def test_table_reads_its_rules():
    table = zone_table()
    assert len(table.zones) > 300 and table.version != ""
    assert table.get("europe/berlin").abbreviations["CEST"] == 7200
    with pytest.raises(ValueError):
        parse_tzif(b"nonsense")


def test_table_of_readings(spark):
    places = spark.createDataFrame([(1, BERLIN, "dmy", "x"), (2, DENVER, "mdy", "y")], "location_id long, time_zone string, date_order string, country string")
    rows = [(1, 1, "2024-05-01 09:00:00", "own"), (2, 2, "5/1/2024 09:00", None), (3, 3, "2024-05-01 09:00:00", "?"), (4, None, "2024-05-01T07:00:00Z", "?"), (5, 1, None, "?"), (6, 1, "junk", "?")]
    df = spark.createDataFrame(rows, "reading_id long, location_id long, date string, time_zone string")
    got = {r["reading_id"]: (r["utc_us"], r["time_zone"]) for r in with_instant(df, places).collect()}
    assert got == {1: (us("2024-05-01T07:00:00"), "own"), 2: (us("2024-05-01T15:00:00"), None), 3: (None, "?"), 4: (us("2024-05-01T07:00:00"), "?"), 5: (None, "?"), 6: (None, "?")}
    assert with_instant(df.limit(0), places).collect() == []
    assert with_instant(df, places.limit(0)).where("utc_us is not null").count() == 1


def test_whole_table_like_row_by_row(spark, tiny):
    rows = spark.sql(f"select h.reading_id, h.date, l.time_zone, l.date_order from parquet.`{tiny}/hourly.parquet` h left join parquet.`{tiny}/locations.parquet` l using (location_id)").collect()
    want = {r[0]: brute.instant(r[1], r[2], r[3]) for r in rows}
    assert {r[0]: r[1] for r in general.p6_instants(spark, tiny).collect()} == want


def test_digits_beyond_the_microsecond():
    """Any number of them, however long the text."""

    texts = [f"2024-05-01T07:00:00.123456{'7' * k}Z" for k in (0, 1, 6, 7, 60, 5000)] + ["x" * 5000]
    got = parse_times(pa.array(texts), pa.array([None] * 7, pa.string()), pa.array([None] * 7, pa.string()), zone_table()).to_pylist()
    assert got == [1714546800123456] * 6 + [None]
