"""Implausible readings: out of range, stuck, or spikes against the source's normal behaviour."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.stats import esd_limit
from ..session import write_between
from .ranks import middle_values, running_by_key
from .readings import HOUR_US, floor_div, is_number, one_per_instant

#: Rows of a source that one task takes together. A source with more is cut into stretches of
#: so many readings, and its medians and ranks are counted across them; both ways give the same.
STRETCH = 4096
#: Readings over which the trend is a running median. It outlasts spikes of up to
#: (LEVEL - 1) / 2 readings.
LEVEL = 11
#: Neighbours that a stretch sees of those next to it: a whole window of the trend.
HALO = LEVEL
#: Readings that an hour of the day needs for a seasonal part of its own: a week of them, so that
#: three outliers can't move it.
LEAST_SEASON = 7
#: The spread of normal values whose absolute deviations have a median of 1, and of those
#: whose successive changes have a median of 1.
SPREAD_OF_DEVIATION, SPREAD_OF_CHANGE = 1.4826, 1.0482
#: Decimals of a remainder; what differs by less is one value.
DECIMALS = 9


def running_median(x: np.ndarray, width: int = LEVEL) -> np.ndarray:
    """Median of the `width` values around each one; the first and last take their nearest whole window."""
    if len(x) <= width:
        return np.full(len(x), np.median(x) if len(x) else 0.0)
    half = width // 2
    inner = np.partition(np.lib.stride_tricks.sliding_window_view(x, width), half, axis=1)[:, half]
    return np.pad(inner, half, mode="edge")


def pulse_height(x: np.ndarray, longest: int) -> np.ndarray:
    """How far each reading stands out as part of a pulse.

    The most, over all stretches of at most `longest` successive readings that hold it, by
    which the whole stretch lies above (or below) both readings next to it; negative or
    -inf where none does.
    """
    n = len(x)
    best = np.full(n, -np.inf)
    for width in range(1, longest + 1):
        if n < width + 2:
            break
        inner = np.lib.stride_tricks.sliding_window_view(x[1:-1], width)
        before, after = x[: n - width - 1], x[width + 1 :]
        height = np.maximum(inner.min(axis=1) - np.maximum(before, after), np.minimum(before, after) - inner.max(axis=1))
        for k in range(width):
            at = np.arange(len(height)) + 1 + k
            best[at] = np.maximum(best[at], height)
    return best


def decompose(t: np.ndarray, x: np.ndarray, place: np.ndarray, longest: int = 3, run: int = 8) -> dict[str, np.ndarray]:
    """Change, run mark, pulse height, hour of day and value off the trend of successive readings of one source.

    `place` is the number of each reading in its source's series with out-of-range readings;
    a step of more than one means that such a reading lies between, which ends a run. The
    trend is the running median; the seasonal part is taken off later, as it needs the whole
    source.
    """
    n = len(x)
    step = np.diff(x)
    change = np.full(n, np.nan)
    change[1:] = np.abs(step)
    same = np.zeros(n, dtype=bool)
    same[1:] = (step == 0) & (np.diff(place) == 1)
    begins = np.flatnonzero(~same)
    sizes = np.diff(np.append(begins, n))
    return {
        "change": change,
        "stuck": np.repeat(sizes >= run, sizes),
        "height": pulse_height(x, longest),
        "hour": np.floor_divide(t, HOUR_US) % 24,
        "off": np.round(x - running_median(x), DECIMALS),
    }


def seasonal_profile(off: np.ndarray, hour: np.ndarray) -> np.ndarray:
    """Median by hour of day of what is off the trend; 0 for an hour with too few readings."""
    order = np.lexsort((off, hour))
    size = np.bincount(hour, minlength=24)
    begin, ordered = np.cumsum(size) - size, off[order]
    some = np.flatnonzero(size >= LEAST_SEASON)
    out = np.zeros(24)
    out[some] = (ordered[begin[some] + (size[some] - 1) // 2] + ordered[begin[some] + size[some] // 2]) / 2
    return out


def esd_limits(most: int, alpha: float) -> np.ndarray:
    """Limit of the generalised extreme studentised deviate test by the number of values left.

    The i-th step on n values depends on n - i + 1 alone; infinite below three.
    """
    left = np.arange(most + 1)
    return np.nan_to_num(np.where(left >= 3, esd_limit(left, np.ones_like(left), alpha), np.inf), nan=np.inf)


def esd_floor(size: np.ndarray, scale: float, limits: np.ndarray) -> float:
    """The least size of a remainder that the test calls an outlier; infinite if none is.

    Remainders are measured by `scale`, which outliers hardly move, so it stays for all steps.
    Up to half of the values are tested; the last step beyond its limit decides.
    """
    down = np.sort(size)[::-1][: len(size) // 2]
    beyond = np.flatnonzero(down > limits[len(size) - np.arange(len(down))] * scale)
    return down[beyond[-1]] if len(beyond) else np.inf


def spikes_of(parts: dict[str, np.ndarray], limits: np.ndarray, factor: float) -> np.ndarray:
    """Which readings of a whole source are spikes: an outlying remainder, then the stated height."""
    n, plain = len(parts["off"]), ~parts["stuck"]
    if n < 3:
        return np.zeros(n, dtype=bool)
    usual = np.median(parts["change"][1:])
    rest = np.round(np.abs(parts["off"] - seasonal_profile(parts["off"][plain], parts["hour"][plain])[parts["hour"]]), DECIMALS)
    scale = SPREAD_OF_DEVIATION * np.median(rest[plain]) if plain.any() else 0.0
    least = esd_floor(rest[plain], scale or SPREAD_OF_CHANGE * usual, limits)
    return plain & (rest >= least) & (parts["height"] > factor * usual)


def _flags(low: float, high: float, factor: float, limits: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """The stuck readings and spikes of one source whose rows are all there: (delivery, reason)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["t", "delivery", "x"]).sort_by([("t", "ascending"), ("delivery", "ascending")]).combine_chunks()
        t, x = table["t"].to_numpy(), table["x"].to_numpy()
        first = np.append(True, t[1:] != t[:-1])
        which = np.cumsum(first) - 1
        told = first & np.asarray(table["delivery"].is_valid())  # nulls stand last: such an instant has no id at all
        fine = told & (x >= low) & (x <= high)
        place = np.cumsum(told) - 1
        parts = decompose(t[fine], x[fine], place[fine])
        out = []
        for reason, hit in (("stuck", parts["stuck"]), ("spike", spikes_of(parts, limits, factor))):
            at = np.zeros(which[-1] + 1, dtype=bool)
            at[which[fine][hit]] = True
            ids = table["delivery"].filter(pa.array(at[which] & (x >= low) & (x <= high)))
            out.append(pa.table({"delivery": ids, "reason": pa.repeat(reason, len(ids))}))
        return pa.concat_tables(out)

    return run


def _stretches(one: DataFrame, low: float, high: float) -> DataFrame:
    """(source, stretch, pos, out, t, x): in-range readings by stretch, with halo; `pos` is a reading's
    number along its source and `out` that of the out-of-range readings before it.

    Numbers along a source are counted by hour first and summed over the hours of a source, so
    that no task sorts a whole source.
    """
    fine = F.col("x").between(low, high)
    one = one.withColumn("slot", floor_div(F.col("t"), HOUR_US))
    slots = one.groupBy("source", "slot").agg(F.count("*").alias("n"), F.count_if(fine).alias("fine"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(
        F.col("source").alias("source_"), F.col("slot").alias("slot_"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("fine").over(before), F.lit(0)).alias("fine_before"),
    )
    inside = Window.partitionBy("source", "slot").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        one.select("*", F.count(F.lit(1)).over(inside).alias("n_in"), F.count_if(fine).over(inside).alias("fine_in"))
        .where(fine)
        .join(slots, F.col("source").eqNullSafe(F.col("source_")) & (F.col("slot") == F.col("slot_")))
        .select("source", "t", "x", (F.col("fine_before") + F.col("fine_in") - 1).alias("pos"), (F.col("n_before") + F.col("n_in") - F.col("fine_before") - F.col("fine_in")).alias("out"))
    )
    own, into = floor_div(F.col("pos"), STRETCH), F.pmod(F.col("pos"), F.lit(STRETCH))
    homes = F.array_compact(F.array(own, F.when((into < HALO) & (own > 0), own - 1), F.when(into >= STRETCH - HALO, own + 1)))
    return placed.select("*", F.explode(homes).alias("stretch"))


def _decomposed(table: pa.Table) -> pa.Table:
    """What a stretch tells of its source, by `kind`: how often each change occurs (`change`), how often
    each value off the trend at each hour (`off`), and its readings that are stuck or stand out (`told`)."""
    table = table.combine_chunks()
    order = np.argsort(table["pos"].to_numpy())
    t, x, pos, out, stretch = (table[c].to_numpy()[order] for c in ("t", "x", "pos", "out", "stretch"))
    parts = decompose(t, x, pos + out)
    core = pos // STRETCH == stretch
    changes, often = np.unique(parts["change"][core & ~np.isnan(parts["change"])], return_counts=True)
    plain = core & ~parts["stuck"]
    offs, off_often = np.unique(np.stack([parts["hour"][plain].astype(float), parts["off"][plain]]), axis=1, return_counts=True)
    told = core & (parts["stuck"] | (parts["height"] > 0))
    k, m, n = len(changes), offs.shape[1], int(told.sum())
    none = lambda size: np.zeros(size)
    return pa.table({
        "source": pa.repeat(table["source"][0], k + m + n),
        "kind": pa.concat_arrays([pa.repeat("change", k), pa.repeat("off", m), pa.repeat("told", n)]),
        "t": pa.concat_arrays([pa.nulls(k + m, pa.int64()), pa.array(t[told], pa.int64())]),
        "hour": np.concatenate([none(k), offs[0], parts["hour"][told]]).astype(np.int64),
        "value": np.concatenate([changes, offs[1], parts["off"][told]]),
        "often": np.concatenate([often, off_often, none(n)]).astype(np.int64),
        "height": np.concatenate([none(k + m), parts["height"][told]]),
        "stuck": np.concatenate([np.zeros(k + m, dtype=bool), parts["stuck"][told]]),
    })


def _limits(left: Column, alpha: float) -> Column:
    @F.pandas_udf("double")
    def limit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for a in batches:
            yield pd.Series(np.where(a >= 3, esd_limit(a.to_numpy(), np.ones(len(a)), alpha), np.inf))

    return limit(left)


def _renamed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_" for c in columns})


def _across(one: DataFrame, low: float, high: float, factor: float, alpha: float) -> DataFrame:
    """(source, t, reason): stuck readings and spikes of sources of any length, from stretches.

    Medians and ranks of a source come from counts of equal values, ordered by ranges of
    (source, value): no task sees a whole source.
    """
    kind = dict(one.dtypes)["source"]
    schema = f"source {kind}, kind string, t long, hour long, value double, often long, height double, stuck boolean"
    parts = write_between(_stretches(one, low, high).groupBy("source", "stretch").applyInArrow(_decomposed, schema), "stretches")
    same = lambda *also: [F.col("source").eqNullSafe(F.col("source_")), *(F.col(c) == F.col(f"{c}_") for c in also)]

    changes = parts.where("kind = 'change'").groupBy("source", "value").agg(F.sum("often").alias("often"))
    usual = middle_values(changes, ["source"], "value", "often").select("source", F.col("middle").alias("usual"))
    offs = parts.where("kind = 'off'").groupBy("source", "hour", "value").agg(F.sum("often").alias("often"))
    offs = write_between(offs, "offs")
    profile = middle_values(offs, ["source", "hour"], "value", "often").where(F.col("n") >= LEAST_SEASON).select("source", "hour", F.col("middle").alias("season"))
    profile = _renamed(write_between(profile, "profile"), "source", "hour")

    def rest(df: DataFrame) -> DataFrame:
        size = F.round(F.abs(F.col("value") - F.coalesce("season", F.lit(0.0))), DECIMALS)
        return df.join(profile, same("hour"), "left").drop("source_", "hour_").withColumn("rest", size)

    sizes = write_between(rest(offs).groupBy("source", "rest").agg(F.sum("often").alias("often")), "sizes")
    spread = middle_values(sizes, ["source"], "rest", "often").select("source", "n", (F.col("middle") * SPREAD_OF_DEVIATION).alias("spread"))
    sources = usual.join(_renamed(spread, "source"), same()).drop("source_")
    scale = F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.col("usual") * SPREAD_OF_CHANGE)
    sources = _renamed(write_between(sources.select("source", "n", "usual", scale.alias("scale")), "sources"), "source")

    # the size at the i-th place from the top, i being the last place that equal sizes take
    placed = running_by_key(sizes, ["source"], "rest", "often").join(sources, same()).drop("source_")
    step = F.col("n") - (F.col("upto") - F.col("often"))
    last = F.least(step, F.floor(F.col("n") / 2))
    tested = placed.withColumn("last", last).where((F.col("last") > F.col("n") - F.col("upto")) & (F.col("rest") > F.col("scale")))
    outlying = tested.where(F.col("rest") > _limits(F.col("n") - F.col("last") + 1, alpha) * F.col("scale"))
    least = _renamed(outlying.groupBy("source").agg(F.min("rest").alias("least")), "source")

    told = parts.where("kind = 'told'")
    tall = told.where("height > 0").join(sources, same()).where(F.col("height") > factor * F.col("usual")).drop("source_")
    spikes = rest(tall).join(least, same()).where(F.col("rest") >= F.col("least"))
    return told.where("stuck").select("source", "t", F.lit("stuck").alias("reason")).unionByName(spikes.select("source", "t", F.lit("spike").alias("reason")))


def implausible_readings(
    df: DataFrame,
    source: str = "sensor_id",
    time: str = "utc_us",
    value: str = "aqi",
    delivery: str = "reading_id",
    low: float = 0.0,
    high: float = 600.0,
    factor: float = 10.0,
    alpha: float = 0.05,
    together: int = STRETCH,
) -> DataFrame:
    """(delivery, reason): the readings of `df` that can't be believed; reasons `range`, `stuck`, `spike`.

    * range: the value lies outside [low, high]; the row needs no time.
    * stuck: part of eight or more successive readings of a source with exactly one value.
    * spike: each source is decomposed into a trend (running median of 11 readings), a
      seasonal part (median by hour of day of what is off the trend) and a remainder. The
      generalised extreme studentised deviate test, with the median absolute remainder as
      its measure of spread, decides which remainders are outliers; stuck readings, which
      have a check of their own, take no part in the spread. Of the outliers those are spikes
      that belong to one to three successive readings lying above (or below) both neighbours
      by more than `factor` times the source's median change between successive readings.

    Null and NaN values are skipped everywhere; rows without a time in stuck and spike;
    out-of-range readings in spike, and they end a run. Deliveries of one reading (same
    source and instant) count once, by the lowest id, and are all flagged. A null source is
    a source of its own; sources with fewer than three readings have no spikes; where all
    remainders are 0 the spread follows from the median change. An empty table gives no rows.

    A source of at most `together` rows is judged in one group; a longer one in stretches,
    whose counts are brought together. The result is the same.
    """
    rows = df.select(F.col(source).alias("source"), F.col(time).alias("t"), F.col(value).alias("x"), F.col(delivery).alias("delivery")).where(is_number(F.col("x")))
    ranged = rows.where(~F.col("x").between(low, high)).select("delivery", F.lit("range").alias("reason"))
    long = rows.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > together).select(F.col("source").alias("source_"))
    long = write_between(long, "long")
    timed = rows.where(F.col("t").isNotNull())
    of = F.col("source").eqNullSafe(F.col("source_"))
    schema = f"delivery {dict(rows.dtypes)['delivery']}, reason string"
    limits = esd_limits(together, alpha)
    short = timed.join(long, of, "left_anti").groupBy("source").applyInArrow(_flags(low, high, factor, limits), schema)
    out = ranged.unionByName(short)
    if long.isEmpty():
        return out

    rest = write_between(timed.join(long, of, "left_semi"), "readings")
    one = write_between(one_per_instant(rest, "source", "t", "x", "delivery"), "instants")
    marks = _renamed(_across(one, low, high, factor, alpha), "source", "t")
    delivered = rest.where(F.col("x").between(low, high)).join(marks, of & (F.col("t") == F.col("t_")))
    return out.unionByName(delivered.select("delivery", "reason"))
