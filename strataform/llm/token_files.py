"""Token ids in patched frame-of-reference blocks.

A *segment* holds the ids of some whole documents in ascending document order::

    magic "PFR1" | u32 documents | u32 ids | u32 blocks | u16 ids in a block | u16 0
    i64 id of each document | u8 whether it is null | u32 ids of each document
    u32 start of each block in what follows
    blocks: u32 minimum | u8 width | u8 exceptions | packed low bits | u8 positions | u32 high bits

A block subtracts its minimum, packs the differences at the width that a chosen
percentile of them needs, and keeps the bits that do not fit as an exception list.
Segments are rows of a Parquet table (bucket, seq, n_docs, n_ids, data) that Spark
commits as a whole, so that a lost executor leaves no half-written file behind.
"""

from __future__ import annotations

import array
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import bound_batches, only, partitions, pieces, scratch_path

BLOCK = 128
#: The smallest tie.
LEAST = -(1 << 63)
HEAD = struct.Struct("<4sIIIHH")


def packed_bits(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers below 2**width, a multiple of 8 in each, as bytes, lowest bits first.

    Numbers 8 places apart start at the same bit of bytes ``width`` apart.
    """
    rows, n = x.shape
    out = np.zeros((rows, n * width // 8 + 4), np.uint8)
    kind = np.uint32 if width <= 25 else np.uint64
    x = x.astype(kind)
    for r in range(8):
        at, shift = r * width >> 3, r * width & 7
        own = x[:, r::8] << kind(shift)
        for k in range((shift + width + 7) // 8):
            out[:, at + k : at + k + n // 8 * width : width][:, : n // 8] |= (own >> kind(8 * k)).astype(np.uint8)
    return out[:, : n * width // 8]


def unpacked_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The ``n`` numbers of each row of ``packed_bits``."""
    padded = np.zeros((len(data), data.shape[1] + 5), np.uint8)
    padded[:, : data.shape[1]] = data
    bit = np.arange(n) * width
    kind = np.uint32 if width <= 25 else np.uint64
    at, shift = bit >> 3, (bit & 7).astype(kind)
    out = np.zeros((len(data), n), kind)
    for k in range((7 + width + 7) // 8):
        out |= padded[:, at + k].astype(kind) << kind(8 * k)
    return (out >> shift & kind((1 << width) - 1)).astype(np.uint32)


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = 0.9) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks and their bytes.  At most 255 ids make a block."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint32), b""
    count = -(-n // block)
    x = np.empty(count * block, np.uint32)
    x[:n], x[n:] = ids, ids[-1]
    x = x.reshape(count, block)
    low = x.min(axis=1)
    x = x - low[:, None]
    at = min(block - 1, max(0, math.ceil(percentile * block) - 1))
    widths = np.frexp(np.partition(x, at, axis=1)[:, at].astype(np.float64))[1].astype(np.int64)
    over = np.where(widths[:, None] < 32, x >> np.minimum(widths, 31)[:, None].astype(np.uint32), np.uint32(0))
    packed: list[bytes] = [b""] * count
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        if w:
            size = -(-block * int(w) // 8)
            if w == 16:  # whole bytes need no packing
                flat = x[rows].astype("<u2").tobytes()
            else:
                flat = packed_bits(x[rows] & np.uint32((1 << int(w)) - 1), int(w)).tobytes()
            for k, r in enumerate(rows.tolist()):
                packed[r] = flat[k * size : (k + 1) * size]
    out, starts = [], np.empty(count, np.uint32)
    which, where = np.nonzero(over)
    cuts = np.searchsorted(which, np.arange(count + 1))
    where8, high = where.astype(np.uint8), over[which, where]
    heads, places, highs = low.tolist(), where8.tobytes(), high.astype("<u4").tobytes()
    cuts, each = cuts.tolist(), widths.tolist()
    sizes = []
    for k in range(count):
        a, b = cuts[k], cuts[k + 1]
        data = struct.pack("<IBB", heads[k], each[k], b - a) + packed[k]
        if a < b:
            data += places[a:b] + highs[4 * a : 4 * b]
        sizes.append(len(data))
        out.append(data)
    starts[1:] = np.cumsum(sizes)[:-1]
    starts[0] = 0
    return starts, b"".join(out)


def unpack_blocks(starts: np.ndarray, data: bytes, n: int, block: int = BLOCK, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of the blocks ``first`` to ``last`` (all by default), found through the index."""
    last = len(starts) if last is None else last
    out = np.zeros((last - first, block), np.uint32)
    if not out.size:
        return out.reshape(-1)
    raw = np.frombuffer(data, np.uint8)
    at = starts[first:last].astype(np.int64)
    low = raw[at[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    widths, extra = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
    size = -(-block * widths // 8)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        if w:
            body = raw[(at[rows] + 6)[:, None] + np.arange(-(-block * w // 8))]
            if w == 16:
                out[rows] = body.view("<u2")
                continue
            out[rows] = unpacked_bits(body, block, int(w))
    if extra.any():
        block_of = np.repeat(np.arange(len(extra)), extra)
        nth = np.arange(len(block_of)) - np.repeat(np.cumsum(extra) - extra, extra)
        lists = at + 6 + size
        where = raw[lists[block_of] + nth]
        high = raw[(lists + extra)[block_of][:, None] + 4 * nth[:, None] + np.arange(4)].view("<u4").reshape(-1)
        out[block_of, where] |= (high.astype(np.uint64) << widths[block_of].astype(np.uint64)).astype(np.uint32)
    out += low[:, None]
    return out.reshape(-1)[: n - first * block]


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float = 0.9) -> bytes:
    starts, body = pack_blocks(ids, BLOCK, percentile)
    return b"".join([
        HEAD.pack(b"PFR1", len(doc_ids), len(ids), len(starts), BLOCK, 0),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        np.array(lengths, "<u4").tobytes(),
        starts.astype("<u4").tobytes(),
        body,
    ])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and ids of a segment."""
    magic, docs, n, blocks, block, _ = HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a token segment")
    at = HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at).tolist()
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    starts = np.frombuffer(data, "<u4", blocks, at + 13 * docs)
    ids = unpack_blocks(starts, data[at + 13 * docs + 4 * blocks :], n, block)
    return [None if z else d for d, z in zip(doc_ids, null, strict=True)], lengths, ids


#: Rows of the sample for each bucket, and the most buckets.
SAMPLED, MOST_BUCKETS = 20, 20_000


def bucket_bounds(source: DataFrame, bucket_rows: int) -> list[tuple[int | None, int]]:
    """Pairs (doc_id, tie) that cut the rows into buckets of about equal numbers, null ids first.

    The bounds come from a random sample of about ``SAMPLED`` rows a bucket and only decide the
    layout.  Ids that are bounds of several buckets are looked at again, with a sample of
    their ties, so that no id makes a large bucket; texts of others are not read for this.
    """
    total = source.count()
    n = min(MOST_BUCKETS, max(partitions(source.sparkSession), -(-total // bucket_rows)))
    share = min(1.0, SAMPLED * n / max(1, total))
    some = sorted((r["doc_id"] for r in source.select("doc_id").sample(share, 5).collect()), key=lambda d: (d is not None, d or 0))
    cuts = [some[len(some) * k // n] for k in range(1, n)] if some else []
    hot = {d: cuts.count(d) for d in set(cuts) if cuts.count(d) > 1}
    out: list[tuple[int | None, int]] = [(d, LEAST) for d in dict.fromkeys(cuts) if d not in hot]
    if hot:
        own = source.where(F.col("doc_id").isin([d for d in hot if d is not None]) | (F.col("doc_id").isNull() if None in hot else F.lit(False)))
        ties: dict[int | None, list[int]] = {}
        for r in own.select("doc_id", "tie").sample(share, 6).collect():
            ties.setdefault(r["doc_id"], []).append(r["tie"])
        for d, held in ties.items():
            held.sort()
            out += [(d, LEAST), *((d, held[len(held) * k // hot[d]]) for k in range(1, hot[d]))]
    return sorted(set(out), key=lambda b: (b[0] is not None, b[0] or 0, b[1]))


class Bounds:
    """Buckets of rows by (doc_id, tie)."""

    def __init__(self, bounds: list[tuple[int | None, int]]) -> None:
        self.nulls = np.array([t for d, t in bounds if d is None], np.int64)
        self.ids = np.array([d for d, _ in bounds if d is not None], np.int64)
        self.ties = np.array([t for d, t in bounds if d is not None], np.int64)

    def __call__(self, ids: pa.Array, ties: np.ndarray) -> np.ndarray:
        null = ids.is_null().to_numpy(zero_copy_only=False)
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        low, high = (np.searchsorted(self.ids, known, side=x) for x in ("left", "right"))
        out = low.copy()
        for a in np.unique(low[high > low]).tolist():
            rows = np.flatnonzero((low == a) & (high > low))
            out[rows] += np.searchsorted(self.ties[a : high[rows[0]]], ties[rows], side="right")
        return np.where(null, np.searchsorted(self.nulls, ties, side="right"), len(self.nulls) + out).astype(np.int32)


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    bucket_rows: int = 20_000,
    segment_ids: int = 1 << 18,
    percentile: float = 0.9,
    cache: int = 700_000,
) -> None:
    """Writes the ids of all texts, each with ``end_id`` after it, in ascending order of document id.

    A null or empty text has only the end id.  Null ids come first.  Rows that share an id
    are kept, in the order of ``xxhash64`` of their texts.  An empty table gives an empty file set.
    Ids of documents must be integers; other columns are ignored.  A document is never cut:
    a segment ends with the document that takes it past ``segment_ids``.
    """
    import zstandard

    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    bounds = bucket_bounds(source, bucket_rows)
    n = len(bounds) + 1
    wide = bpe.load(tokenizer).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    code, kind = ("I", np.uint32) if wide else ("H", np.uint16)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = only(("token files", tokenizer, code, cache), lambda: bpe.Chunks(tokenizer, code, cache))
        bucket_of = Bounds(bounds)
        end = array.array(code, [end_id]).tobytes()
        shrink = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, 4000, 10 << 20):
            ids = [shrink.compress(x + end) for x in chunks.texts([t or "" for t in batch.column(1).to_pylist()])]
            ties = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column(0), ties)), batch.column(0), batch.column(2), pa.array(ids, pa.binary())], ["bucket", "doc_id", "tie", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        bucket, seq, held, names, lengths, total = None, 0, [], [], [], 0

        def segment() -> pa.RecordBatch:
            data = write_segment(names, lengths, np.concatenate(held), percentile)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([total], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for b, d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if names and (b != bucket or total >= segment_ids):
                    yield segment()
                    seq = seq + 1 if b == bucket else 0
                    held, names, lengths, total = [], [], [], 0
                bucket = b
                ids = np.frombuffer(grow.decompress(x.as_py()), kind)
                held.append(ids)
                names.append(d)
                lengths.append(len(ids))
                total += len(ids)
        if names:
            yield segment()

    rows = source.mapInArrow(encode, "bucket int, doc_id bigint, tie bigint, ids binary")
    dealt = rows.repartitionById(n, "bucket").sortWithinPartitions("bucket", "doc_id", "tie", "ids")
    dealt.mapInArrow(pack, "bucket int, seq int, n_docs bigint, n_ids bigint, data binary").write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone.

    ``start`` is the number of ids of all documents before it.  Sums are taken inside a
    bucket first, so that no task sees more than one row for each bucket.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                names, lengths, ids = read_segment(data.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "doc_id": pa.array(names, pa.int64()), "inside": pa.array(ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    files = spark.read.schema("bucket int, seq int, n_docs bigint, n_ids bigint, data binary").parquet(path)
    found = files.select("bucket", "seq", "data").mapInArrow(describe, "bucket int, seq int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    buckets = files.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("bucket", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("offset")).join(buckets, "bucket")
    return found.join(segments, ["bucket", "seq"]).select("doc_id", (F.col("base") + F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, *, path: str | None = None, **options) -> DataFrame:
    """Writes the files and returns what reading them back gives."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
