"""Bit filters of a bounded size, built by executors and merged in a tree."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tree_merge

#: A filter never takes more bits than this (32 MB); beyond, it lets more rows through.
MOST_BITS = 1 << 28


def bits_for(items: int, each: int = 8, most: int = MOST_BITS) -> int:
    """A power of two of at least ``each`` bits for every item, within the bound."""
    return min(most, max(1 << 16, 1 << max(1, items * each - 1).bit_length()))


def spots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions in the filter for each 64-bit hash."""
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) >> np.uint64(3) & mask).astype(np.int64)


class Filter:
    """A Bloom filter with two hash functions over 64-bit hashes."""

    def __init__(self, bits: int, data: bytes | None = None) -> None:
        self.bits = bits
        self.words = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for at in spots(hashes, self.bits):
            np.bitwise_or.at(self.words, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        a, b = spots(hashes, self.bits)
        return ((self.words[a >> 3] >> (a & 7)) & (self.words[b >> 3] >> (b & 7)) & 1).astype(bool)


def merge_pairs(a: bytes, b: bytes) -> bytes:
    """Two packed (once, twice) pairs as one: what both have seen once has been seen twice."""
    x, y = (np.frombuffer(zlib.decompress(p), np.uint8).reshape(2, -1) for p in (a, b))
    return zlib.compress(np.stack([x[0] | y[0], x[1] | y[1] | (x[0] & y[0])]).tobytes(), 1)


def repeated(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> bytes:
    """Bits of a filter that has every hash which two or more of the arrays contain.

    ``hashes_of`` gives one array of distinct hashes for each row.  A first filter holds
    what has been seen once; what meets itself there enters the second.  Merging two
    partitions adds the intersection of their first filters to the second.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(bits), Filter(bits)
        for batch in batches:
            found = list(hashes_of(batch))
            if found and (every := np.concatenate(found)).size:
                values, counts = np.unique(every, return_counts=True)
                twice.add(values[(counts > 1) | once.has(values)])
                once.add(values)
        data = zlib.compress(np.stack([once.words, twice.words]).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["filters"])

    merged = tree_merge(rows.mapInArrow(build, "filters binary"), "filters", merge_pairs, bits // 4)
    if merged is None:
        return bytes(bits // 8)
    return np.frombuffer(zlib.decompress(merged), np.uint8).reshape(2, -1)[1].tobytes()


def membership(rows: DataFrame, bits: int) -> bytes:
    """Bits of a filter over the one bigint column of ``rows``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(own.words.tobytes(), 1)], pa.binary())], ["filter"])

    def union(a: bytes, b: bytes) -> bytes:
        x, y = (np.frombuffer(zlib.decompress(p), np.uint8) for p in (a, b))
        return zlib.compress((x | y).tobytes(), 1)

    merged = tree_merge(rows.mapInArrow(build, "filter binary"), "filter", union, bits // 8)
    return bytes(bits // 8) if merged is None else zlib.decompress(merged)


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is not among the distinct, not null ``keys``.

    Rows that a filter over the keys rules out stay where they are; only the others are
    shuffled, to be compared exactly.
    """
    hashed = F.xxhash64(column)
    keys = stored(keys.select(column), "keys")
    bits = bits_for(keys.count(), 16)
    held = rows.sparkSession.sparkContext.broadcast(membership(keys.select(hashed.alias("h")), bits))

    @F.arrow_udf("boolean")
    def may_be(column: pa.Array) -> pa.Array:
        return pa.array(Filter(bits, held.value).has(column.to_numpy(zero_copy_only=False).view(np.uint64)))

    clear = rows.where(~may_be(hashed))
    return clear.unionByName(rows.where(may_be(hashed)).join(keys, column, "left_anti"))
