"""Percentiles of very large columns from mergeable summaries of collapsed buffers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values in one buffer. On n values the rank error is at most n * log2(n / K) / (2 * K).
K = 1024

#: Values that a task holds in summaries before it hands them on (32 MB).
HELD = 1 << 22


def buffer_size(epsilon: float, n: int) -> int:
    """The least power of two as K with which percentiles of up to `n` values are off by at most `epsilon` of all ranks."""
    k = 2
    while n > k and math.log2(n / k) / (2 * k) > epsilon:
        k *= 2
    return k


#: A summary as columns: number of values, bound of the rank error, values of weight 1 that
#: fill no buffer, and the buffers with the binary logarithms of their weights.
SUMMARY = "n long, err long, tail array<double>, levels array<int>, buffers array<array<double>>"


@dataclass
class Summary:
    """Sorted buffers of exactly `k` values; one at level l stands for k * 2**l values.

    Two buffers of a level collapse into one of the next: of their 2k values in order every
    second is kept, the even and odd places taking turns by how often the level collapsed.
    A collapse to weight w moves the rank of any value by at most w / 2; `err` is the sum.
    At most one buffer stays on a level, so the collapses form a binary tree and the size is
    k * (1 + log2(n / k)) at most, whatever is merged in whatever order.
    """

    k: int = K
    n: int = 0
    err: int = 0
    tail: list[np.ndarray] = field(default_factory=list)
    tail_size: int = 0
    levels: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._push(values)

    def _push(self, values: np.ndarray) -> None:
        self.tail.append(values)
        self.tail_size += len(values)
        if self.tail_size >= self.k:
            every = np.sort(np.concatenate(self.tail))
            full = len(every) // self.k
            # any k values may form a buffer; places dealt in turn keep each one spread out
            for j in range(full):
                self._carry(0, every[j : full * self.k : full])
            self.tail, self.tail_size = [every[full * self.k :]], len(every) - full * self.k

    def _carry(self, level: int, buffer: np.ndarray) -> None:
        while level in self.levels:
            merged = np.sort(np.concatenate([self.levels.pop(level), buffer]), kind="stable")
            buffer = merged[(self.n >> (level + 1)) & 1 :: 2]
            level += 1
            self.err += 1 << (level - 1)
        self.levels[level] = buffer

    def merge(self, n: int, err: int, tail: np.ndarray, levels: np.ndarray, buffers: list[np.ndarray]) -> None:
        self.n += n
        self.err += err
        for level, buffer in zip(levels, buffers):
            self._carry(int(level), buffer)
        self._push(tail)

    def kept(self) -> int:
        return self.tail_size + self.k * len(self.levels)

    def row(self) -> tuple:
        levels = sorted(self.levels)
        tail = np.sort(np.concatenate(self.tail)) if self.tail else np.zeros(0)
        return self.n, self.err, tail, levels, [self.levels[x] for x in levels]

    def quantiles(self, q: np.ndarray) -> np.ndarray:
        """The value at rank ceil(q * n), off by at most `err` ranks; NaN if there is none."""
        if not self.n:
            return np.full(len(q), np.nan)
        n, _, tail, levels, buffers = self.row()
        values = np.concatenate([tail, *buffers])
        weights = np.concatenate([np.ones(len(tail), np.int64), *(np.full(len(b), 1 << x, np.int64) for x, b in zip(levels, buffers))])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        target = np.maximum(1, np.ceil(np.asarray(q) * n - 1e-9))
        return values[order][np.minimum(np.searchsorted(ranks, target), len(values) - 1)]


def _summary_arrays(rows: list[tuple]) -> list[pa.Array]:
    doubles = pa.list_(pa.float64())
    return [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([r[2] for r in rows], doubles),
        pa.array([r[3] for r in rows], pa.list_(pa.int32())),
        pa.array([r[4] for r in rows], pa.list_(doubles)),
    ]


def _bounds(keys: list[pa.Array]) -> np.ndarray:
    """Row numbers at which a run of equal keys begins, and the end."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for key in keys:
        code = np.asarray(key.dictionary_encode().indices.fill_null(-1))
        new[1:] |= code[1:] != code[:-1]
    return np.append(np.flatnonzero(new), n)


def _from_values(keys: list[str], k: int):
    """Batches of keys and values to one summary for each key of a task.

    Keys are held until they hold HELD values together, then handed on; a frequent key is
    collapsed while it is held, so it costs k * (1 + log2(n / k)) values however many it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Summary] = {}
        types: list[pa.DataType] = []
        size = 0

        def out() -> pa.RecordBatch:
            names, rows = list(held), [s.row() for s in held.values()]
            fields = [pa.array([n[i] for n in names], types[i]) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*fields, *_summary_arrays(rows)], names=[*keys, "n", "err", "tail", "levels", "buffers"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in keys]
            table = pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in keys]).combine_chunks()
            columns = [table[c].chunk(0) if table[c].num_chunks else pa.array([], table[c].type) for c in keys]
            values, edges = table["value"].to_numpy(), _bounds(columns)
            firsts = pa.array(edges[:-1])
            for name, a, b in zip(zip(*(c.take(firsts).to_pylist() for c in columns)), edges, edges[1:]):
                s = held.get(name)
                if s is None:
                    s = held[name] = Summary(k)
                before = s.kept()
                s.add(values[a:b])
                size += s.kept() - before
            if size > HELD:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    return run


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy()


def _merged(keys: list[str], k: int, flush: int = 2000):
    """Batches sorted by key to one summary a key; a key may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, summary, done = None, Summary(k), []

        def out() -> pa.RecordBatch:
            fields = [pa.array([r[0][i] for r in done], types[i]) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*fields, *_summary_arrays([r[1] for r in done])], names=[*keys, "n", "err", "tail", "levels", "buffers"])

        types: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in keys]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keys]
            names = list(zip(*(c.to_pylist() for c in columns)))
            n, err = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "err"))
            to, tail = _lists(batch.column(batch.schema.get_field_index("tail")))
            lo, level = _lists(batch.column(batch.schema.get_field_index("levels")))
            bo, inner = batch.column(batch.schema.get_field_index("buffers")).offsets.to_numpy(), batch.column(batch.schema.get_field_index("buffers")).values
            io, values = _lists(inner)
            for i, name in enumerate(names):
                if name != current:
                    if current is not None:
                        done.append((current, summary.row()))
                        if len(done) >= flush:
                            yield out()
                            done = []
                    current, summary = name, Summary(k)
                summary.merge(n[i], err[i], tail[to[i] : to[i + 1]], level[lo[i] : lo[i + 1]], [values[io[j] : io[j + 1]] for j in range(bo[i], bo[i + 1])])
        if current is not None:
            done.append((current, summary.row()))
            yield out()

    return run


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", " + SUMMARY


def summarise(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """(keys, n, err, tail, levels, buffers): one summary for each key of `df`.

    Each task brings the values of a key down to one summary as it reads them; the summaries
    of a key meet first by a salt, as many as there are shuffle partitions, then across
    salts, always two buffers at a time, so that no task sees more than its share of a
    frequent key. Null and NaN values are left out; a null key is a key. The rank error is at
    most n * log2(n / k) / (2 * k) (`buffer_size` gives k for a wanted error), and counted.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("value"))
    schema = _schema(rows, keys)
    first = rows.mapInArrow(_from_values(keys, k), schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = [*keys, "salt"]
    first = first.repartition(*salted).sortWithinPartitions(*salted).mapInArrow(_merged(salted, k), _schema(first, salted))
    return combine(first, keys, k)


def combine(summaries: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Summaries of separate parts (days, files, places) brought together by `keys`."""
    columns = [*keys, "n", "err", "tail", "levels", "buffers"]
    return summaries.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged(keys, k), _schema(summaries, keys))


def percentile_of(n: Column, err: Column, tail: Column, levels: Column, buffers: Column, q: list[float], k: int = K) -> Column:
    """array<double>: the value at rank ceil(q * n) for each q, off by at most `err` ranks."""

    @F.arrow_udf("array<double>")
    def read(n: pa.Array, err: pa.Array, tail: pa.Array, levels: pa.Array, buffers: pa.Array) -> pa.Array:
        (to, t), (lo, level), bo = _lists(tail), _lists(levels), buffers.offsets.to_numpy()
        io, values = _lists(buffers.values)
        out = []
        for i, (size, bound) in enumerate(zip(n.to_pylist(), err.to_pylist())):
            s = Summary(k, size, bound, [t[to[i] : to[i + 1]]])
            s.levels = {int(x): values[io[j] : io[j + 1]] for x, j in zip(level[lo[i] : lo[i + 1]], range(bo[i], bo[i + 1]))}
            out.append(s.quantiles(np.array(q)))
        return pa.array(out, pa.list_(pa.float64()))

    return read(n, err, tail, levels, buffers)


def percentiles(summaries: DataFrame, keys: list[str], q: dict[str, float], k: int = K) -> DataFrame:
    """(keys, n, one column for each of `q`, rank_error): read off the summaries."""
    at = percentile_of(*(F.col(c) for c in ("n", "err", "tail", "levels", "buffers")), list(q.values()), k)
    read = summaries.select(*keys, "n", F.col("err").alias("rank_error"), at.alias("at"))
    return read.select(*keys, "n", *(F.col("at")[i].alias(name) for i, name in enumerate(q)), "rank_error")
