import random

import pytest
from pyspark.sql import functions as F

from airledger.llm import queries
from airledger.llm.overlap import canonical_hash, cross_split_pairs, overlap_counts

SCHEMA = "row long, split string, station_no long, image_id long, dup_group long, phash long, extra string"


def plain_pairs(rows, distance=5):
    train = [r for r in rows if r[1] == "train"]
    other = [r for r in rows if r[1] in ("cal", "test")]
    out = set()
    for a in train:
        for b in other:
            same = (a[3] is not None and a[3] == b[3]) or (a[4] is not None and a[4] == b[4])
            near = a[5] is not None and b[5] is not None and ((a[5] ^ b[5]) & (2**64 - 1)).bit_count() <= distance
            if a[0] != b[0] and (same or near):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def signed(x):
    x &= 2**64 - 1
    return x - 2**64 if x >> 63 else x


def made(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(56) | 0x9C << 56 for _ in range(n // 6)]
    rows = []
    for i in range(n):
        h = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 7)):
            h ^= 1 << b
        rows.append((i, rng.choice(["train", "train", "cal", "test", None]), rng.randint(1, 9), rng.choice([None, i, rng.randint(0, n // 2)]), rng.choice([None, i, rng.randint(0, n // 2)]), rng.choice([None, signed(h), signed(h)]), "x"))
    return rows


def test_like_all_pairs(spark):
    rows = made(400, 1)
    got = cross_split_pairs(spark.createDataFrame(rows, SCHEMA))
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == plain_pairs(rows)


def test_counts(spark):
    rows = made(300, 2)
    hit = {x for p in plain_pairs(rows) for x in p}
    want = {}
    for r in rows:
        if r[1] in ("cal", "test"):
            key = (r[1], r[2])
            n, o = want.get(key, (0, 0))
            want[key] = (n + 1, o + (r[0] in hit))
    got = {(r["split"], r["station_no"]): (r["photos"], r["overlapping"]) for r in overlap_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_copies_nulls_and_empty(spark):
    same = [(i, "train" if i % 2 else "test", None, 7, None, None, "x") for i in range(40)]
    assert cross_split_pairs(spark.createDataFrame(same, SCHEMA)).count() == 400
    both = [(1, "train", 1, 5, None, None, "x"), (1, "test", 1, 5, None, None, "x")]
    assert cross_split_pairs(spark.createDataFrame(both, SCHEMA)).collect() == []
    nulls = [(1, "train", None, None, None, None, "x"), (2, "test", None, None, None, None, None), (3, None, 1, 1, 1, 1, "x")]
    assert cross_split_pairs(spark.createDataFrame(nulls, SCHEMA)).collect() == []
    assert overlap_counts(spark.createDataFrame(nulls, SCHEMA)).first()["overlapping"] == 0
    assert cross_split_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
    assert overlap_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_canonical_hash(spark):
    df = spark.createDataFrame([("Ab-1 2",), ("ab12",), (" AB 12.",), ("ab13",), (None,)], "t string")
    h = [r[0] for r in df.select(canonical_hash("k", F.col("t"))).collect()]
    assert h[0] == h[1] == h[2] != h[3] and h[4] is None


@pytest.mark.parametrize("scale", ["tiny", "small"])
def test_query(spark, request, scale):
    d = request.getfixturevalue(scale)
    rows = [tuple(r) + (None,) for r in queries._photos(spark, d).select("row", "split", "station_no", "image_id", "dup_group", "phash").collect()]
    assert {tuple(r) for r in queries.p5_found(spark, d).collect()} == plain_pairs(rows)
