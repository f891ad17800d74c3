"""Whole groups into shares, against taking one group after the other."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from airledger.operators.shares import FRACTION, deal, fill_shares, plan_parts, targets
from airledger.operators.splits import cv_folds


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-50, 200), min_size=1, max_size=5), st.integers(1, 20), st.integers(0, 60))
def test_deal_one_by_one(lacks, size, count):
    left, want = list(lacks), [0] * len(lacks)
    for _ in range(count):
        best = max(range(len(left)), key=lambda i: left[i])
        want[best] += 1
        left[best] -= size
    assert deal(lacks, size, count) == want


def test_billions_of_groups_are_planned_at_once():
    plan = plan_parts({1: 10**10, 10**9: 3}, targets({"train": 0.65, "cal": 0.15, "test": 0.2}, 13 * 10**9))
    held = [sum(n * plan[n][i] for n in plan) for i in range(3)]
    assert sum(held) == 13 * 10**9 and held[0] == 8_450_000_000 and max(abs(h - s * 13e9) for h, s in zip(held, (0.65, 0.15, 0.2))) < 2


@pytest.mark.parametrize("sizes", [[], [5], [1] * 7 + [900], [k % 13 + 1 for k in range(400)]])
def test_fill_shares_one_by_one(spark, sizes):
    shares, held = {"train": 0.65, "cal": 0.15, "test": 0.2}, {"test": 30}
    rows = [(f"g{i}", n) for i, n in enumerate(sizes)]
    got = {r["component"]: (r["n"], r["split"]) for r in fill_shares(spark.createDataFrame(rows, "component string, n long"), shares, held).collect()}
    assert {k: n for k, (n, _) in got.items()} == dict(rows)
    left = dict(zip(shares, targets(shares, sum(sizes) + 30)))
    left["test"] -= 30 * FRACTION
    want = Counter()
    for n in sorted(sizes, reverse=True):
        best = max(shares, key=lambda s: left[s])
        left[best] -= n * FRACTION
        want[n, best] += 1
    assert Counter(got.values()) == want


def test_folds_cover_each_station_once(spark):
    rows = [(f"s{i}",) for i in range(60) for _ in range(i % 9 + 1)] + [("huge",)] * 150 + [(None,)] * 4
    out = cv_folds(spark.createDataFrame(rows, "station_id string")).collect()
    assert Counter(r["station_id"] for r in out) == {s: 5 for s, in set(rows) if s}
    tested = Counter(r["station_id"] for r in out if r["role"] == "test")
    assert set(tested.values()) == {1} and len(tested) == 61
    for k in range(5):
        held = Counter()
        for r in out:
            if r["fold"] == k:
                held[r["role"]] += r["n"]
        assert held["cal"] / (held["cal"] + held["train"]) == pytest.approx(0.1875, abs=0.03)
