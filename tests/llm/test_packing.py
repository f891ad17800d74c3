from collections import Counter, defaultdict
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from airledger.llm.packing import fill_one, pack_all, pack_items, plan_containers


def best_fill(capacity, sizes, counts):
    best = 0
    for uses in product(*(range(c + 1) for c in counts)):
        if uses[0] >= 1:
            total = sum(u * s for u, s in zip(uses, sizes))
            best = max(best, total if total <= capacity else 0)
    return best


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 40), st.dictionaries(st.integers(1, 40), st.integers(1, 3), min_size=1, max_size=5))
def test_filling_is_closest_to_capacity(capacity, histogram):
    histogram = {s: c for s, c in histogram.items() if s <= capacity}
    if not histogram:
        return
    sizes = sorted(histogram, reverse=True)
    counts = [histogram[s] for s in sizes]
    used = fill_one(capacity, sizes, counts)
    assert all(0 < n <= counts[k] for k, n in used) and used[0][0] == 0
    assert sum(sizes[k] * n for k, n in used) == best_fill(capacity, sizes, counts)


@settings(max_examples=100, deadline=None)
@given(st.integers(10, 60), st.lists(st.integers(1, 60), max_size=60))
def test_plan_holds_every_item_once(capacity, items):
    histogram = Counter(s for s in items if s <= capacity)
    plan = plan_containers(capacity, histogram)
    held = Counter()
    for repeats, filling in plan:
        assert sum(s * n for s, n in filling) <= capacity
        for s, n in filling:
            held[s] += n * repeats
    assert held == histogram
    assert len(plan) <= max(1, len(histogram)) * 2


def check(rows, sizes, capacity):
    fill, cover = Counter(), defaultdict(list)
    for r in rows:
        fill[r["pack_id"]] += r["n_tokens"]
        cover[r["doc_id"]].append((r["part"], r["start"], r["n_tokens"]))
    assert max(fill.values(), default=0) <= capacity
    assert set(cover) == set(sizes)
    for doc, parts in cover.items():
        parts.sort()
        at = 0
        for k, (part, start, n) in enumerate(parts):
            assert (part, start) == (k, at)
            at += n
        assert at == (sizes[doc] or 0)
        assert len(parts) == 1 or sizes[doc] > capacity
    return fill


def test_items(spark):
    sizes = {i: (i * 37) % 90 for i in range(300)} | {1000: None, 1001: 0, 1002: 100, 1003: 250, 1004: 200, 1005: 99999}
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()], "doc_id long, n_tokens long, pack_id string")
    rows = pack_items(df, 100).collect()
    fill = check(rows, sizes, 100)
    total = sum(v or 0 for v in sizes.values())
    assert len(fill) <= -(-total // 100) + 2
    assert len({r["pack_id"] for r in rows}) == len(fill)


def test_one_size_and_none(spark):
    df = spark.createDataFrame([(i, 7) for i in range(1000)], "doc_id long, n_tokens long")
    fill = check(pack_items(df, 20).collect(), {i: 7 for i in range(1000)}, 20)
    assert len(fill) == 500
    assert pack_items(df.limit(0), 20).collect() == []
    zero = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens long")
    assert [(r["pack_id"], r["n_tokens"]) for r in pack_items(zero, 20).collect()] == [(0, 0), (0, 0)]


def test_several_capacities(spark):
    df = spark.createDataFrame([(i, 1 + i % 50) for i in range(200)], "doc_id long, n_tokens long")
    rows = pack_all(df, [("a", 64), ("b", 256)]).collect()
    for name, capacity in (("a", 64), ("b", 256)):
        own = [r for r in rows if r["pack_name"] == name]
        fill = check(own, {i: 1 + i % 50 for i in range(200)}, capacity)
        assert len(fill) <= -(-sum(1 + i % 50 for i in range(200)) // capacity) + 1
