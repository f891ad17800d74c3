"""Byte-level BPE of whole texts, by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie, unless a caller says otherwise.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the published pattern that cuts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by one worker; when full, the memory starts anew. Longer ones aren't kept.
REMEMBERED, REMEMBERED_LENGTH = 1 << 17, 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece.

    The leaves of the tree hold the rank of the pair that starts at each part, combined with
    its place, so that the root is the leftmost pair of lowest rank. A merge changes three
    leaves; each change climbs to the root, so n bytes take O(n log n) steps.
    """
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    width = 1 << (n - 1).bit_length()
    none = len(ranks) * width + width
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * width + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))  # where the part before it starts
    while (root := tree[1]) < none:
        i = root % width
        j = after[i]
        end = after[j]
        after[i] = end
        if end < n:
            before[end] = i
            rank = ranks.get(piece[i : after[end]])
        else:
            rank = None
        changed = [(j, none), (i, none if rank is None else rank * width + i)]
        if i:
            p = before[i]
            rank = ranks.get(piece[p:end])
            changed.append((p, none if rank is None else rank * width + p))
        for leaf, key in changed:
            k = width + leaf
            if tree[k] == key:
                continue
            tree[k] = key
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    """Encodes texts; every character is ordinary text, there are no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.cut = ranks, regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for piece in self.cut.findall(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8")
                whole = self.ranks.get(raw)
                ids = [whole] if whole is not None else merge(raw, self.ranks)
                if len(piece) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def _encoder_of(spark, path: str):
    """The ranks of a vocabulary file, read by the driver and broadcast: a file's size is
    fixed by its vocabulary, and executors need no copy of it on their disks."""
    return spark.sparkContext.broadcast(read_ranks(path))


def encode_column(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids): the token ids of each text; a null and an empty text give an empty list."""
    ranks = _encoder_of(df.sparkSession, path)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            flat, ends = array("i"), [0]
            for value in batch.column(1):
                value = value.as_py()
                if value:
                    flat.extend(encoder.encode(value))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n_tokens) of each text; 0 for a null or empty one."""
    ranks = _encoder_of(df.sparkSession, path)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            sizes = [len(encoder.encode(value)) if (value := cell.as_py()) else 0 for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["key", "n_tokens"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long").withColumnRenamed("key", key)
