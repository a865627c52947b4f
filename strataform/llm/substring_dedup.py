"""Substring dedup by super-k-mers of words.

The minimiser of a window is the smallest hash among its runs of ``mer`` words.
Consecutive windows with the same minimiser form a super-k-mer, which travels to the
bucket of its minimiser as one packed string; equal windows have equal minimisers and so
meet there, where sorting their digests shows exactly which of them repeat.

What keeps this small and even:

* Texts with the same words form a class; only its smallest document is compared, once for
  each task, and the words of its other members all repeat (if there are enough of them).
* A first pass ships only minimisers.  Those met in one class alone can have no repeated
  window; a Bloom filter of bounded size lets the others' strings through.  False positives
  cost some traffic and change nothing.
* A minimiser with very many windows is not sorted in one bucket: its windows are dealt out
  by their own digest and reduced before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blooms
from .common import bound_batches, encoded, pieces, stored
from .words import BASE, hashed, rolling, sliding_min

MER = 8
#: A minimiser with more windows than this is not sorted in one bucket.
HOT = 200_000
LAST = (1 << 63) - 1


def _words(column: pa.Array) -> list[list[bytes]]:
    return [t.split() if t else [] for t in encoded(column)]


def _class(words: list[bytes]) -> bytes:
    """128-bit digest of the sequence of words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def super_kmers(hashes: np.ndarray, starts: np.ndarray, width: int, mer: int) -> tuple[np.ndarray, ...]:
    """text, first window, number of windows and minimiser of each super-k-mer of a batch."""
    mins = sliding_min(rolling(hashes, mer), width - mer + 1)
    n = np.maximum(np.diff(starts) - width + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    if not len(text):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    mins = mins[starts[text] + inside]
    new = np.ones(len(text), bool)
    new[1:] = (mins[1:] != mins[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], inside[at], np.diff(np.append(at, len(text))), mins[at]


def window_digests(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return rolling(hashes, width, BASE[0]), rolling(hashes, width, BASE[1])


def _unseen(batch: pa.RecordBatch, width: int, seen: set[bytes]) -> tuple[list[list[bytes]], list[bytes]]:
    """Texts with at least a window whose class this task has not met, others emptied; and the classes."""
    words, keys = _words(batch.column(1)), []
    for k, w in enumerate(words):
        key = b""
        if len(w) >= width:
            key = _class(w)
            if key in seen:
                words[k] = []
            seen.add(key)
        else:
            words[k] = []
        keys.append(key)
    return words, keys


def repeated_spans(docs: DataFrame, width: int = 50, mer: int = MER, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Classes (doc_id, n_words, cls) of all rows, and spans (doc_id, cls, a, b) of words to remove.

    ``docs`` has doc_id (long) and text.  A null id counts as the largest.
    """
    spark = docs.sparkSession

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = _words(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([_class(w) for w in words], pa.binary())], ["doc_id", "n_words", "cls"])

    rows = stored(docs.mapInArrow(classify, "doc_id bigint, n_words bigint, cls binary"), "classes")
    known = F.coalesce("doc_id", F.lit(LAST))
    reps = rows.where(F.col("n_words") >= width).groupBy("cls").agg(F.min(known).alias("rep"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in pieces(batches):
            words, keys = _unseen(batch, width, seen)
            hashes, starts = hashed(words)
            text, _, n, mins = super_kmers(hashes, starts, width, mer)
            if len(text):
                order = np.lexsort((text, mins))
                mins, text, n = mins[order], text[order], n[order]
                at = np.flatnonzero(np.append(True, (mins[1:] != mins[:-1]) | (text[1:] != text[:-1])))
                owner = np.array([int.from_bytes(k[:8], "little", signed=True) if k else 0 for k in keys], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mins[at].view(np.int64)), pa.array(owner[text[at]]), pa.array(np.add.reduceat(n, at).astype(np.int32))], ["mini", "owner", "n"])

    marks = docs.mapInArrow(mark, "mini bigint, owner bigint, n int")
    shared = stored(marks.groupBy("mini").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.sum("n").alias("n")).where("lo <> hi").select("mini", "n"), "minimisers")
    bits = blooms.bits_for(shared.count(), 16)
    held = spark.sparkContext.broadcast(blooms.membership(shared.select("mini"), bits))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        known = blooms.Filter(bits, held.value)
        for batch in pieces(batches):
            words, keys = _unseen(batch, width, seen)
            hashes, starts = hashed(words)
            text, first, n, mins = super_kmers(hashes, starts, width, mer)
            hit = known.has(mins)
            text, first, n, mins = text[hit], first[hit], n[hit], mins[hit]
            packed = [b" ".join(words[t][a : a + k + width - 1]) for t, a, k in zip(text.tolist(), first.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(mins.view(np.int64)), pa.array([keys[t] for t in text.tolist()], pa.binary()), pa.array(first.astype(np.int32)), pa.array(packed, pa.binary())], ["mini", "cls", "first", "packed"])

    sent = docs.mapInArrow(ship, "mini bigint, cls binary, first int, packed binary")
    # The smallest document of the class owns its strings; other tasks may have sent the same.
    sent = sent.join(reps, "cls").withColumnRenamed("rep", "doc_id")
    crowded = stored(shared.where(F.col("n") > hot).select("mini"), "crowded")
    if crowded.limit(1).count():
        sent = stored(sent, "kmers")
        spans = _sorted_buckets(sent.join(crowded, "mini", "left_anti"), width).unionByName(_dealt_windows(sent.join(crowded, "mini", "left_semi"), width))
    else:
        spans = _sorted_buckets(sent, width)
    copies = rows.where(F.col("n_words") >= width).join(reps, "cls").where(known > F.col("rep"))
    whole = copies.select(known.alias("doc_id"), "cls", F.lit(0).alias("a"), F.col("n_words").cast("int").alias("b"))
    return rows, spans.unionByName(whole)


def _sorted_buckets(sent: DataFrame, width: int) -> DataFrame:
    """Spans from buckets sorted by minimiser, taken some minimisers at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, int, bytes]] = []
        last, windows = None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if windows > 400_000 and row[0] != last:
                    yield _spans(held, width)
                    held, windows = [], 0
                last = row[0]
                held.append(row)
                windows += row[4].count(b" ") + 2 - width
        if held:
            yield _spans(held, width)

    rows = sent.select("mini", "cls", "doc_id", "first", "packed").repartition("mini").sortWithinPartitions("mini")
    return rows.mapInArrow(run, "doc_id bigint, cls binary, a int, b int")


def _digested(held: list[tuple], width: int) -> tuple[np.ndarray, ...]:
    """row and place in it of each window of the packed strings, with both digests."""
    words = [r[4].split() for r in held]
    hashes, starts = hashed(words)
    d1, d2 = window_digests(hashes, width)
    n = np.diff(starts) - width + 1
    row = np.repeat(np.arange(len(held)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[row] + place
    return row, place, d1[at], d2[at]


def _spans(held: list[tuple], width: int) -> pa.RecordBatch:
    row, place, d1, d2 = _digested(held, width)
    doc = np.array([r[2] for r in held], np.int64)[row]
    order = np.lexsort((doc, d2, d1))
    d1, d2, doc = d1[order], d2[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    hit = np.zeros(len(order), bool)
    hit[order] = doc > least
    return _joined(held, row[hit], place[hit], width)


def _joined(held: list[tuple], row: np.ndarray, place: np.ndarray, width: int) -> pa.RecordBatch:
    """Neighbouring windows of a string as one span."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(row)) - 1
    first = np.array([r[3] for r in held], np.int64)
    a = first[row[at]] + place[at] if len(at) else np.zeros(0, np.int64)
    b = first[row[at]] + place[end] + width if len(at) else np.zeros(0, np.int64)
    own = [held[k] for k in row[at].tolist()]
    return pa.RecordBatch.from_arrays([pa.array([r[2] for r in own], pa.int64()), pa.array([r[1] for r in own], pa.binary()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc_id", "cls", "a", "b"])


def _dealt_windows(sent: DataFrame, width: int) -> DataFrame:
    """Spans of windows that crowd one minimiser: each digest is reduced by itself."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2000):
            held = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            row, place, d1, d2 = _digested(held, width)
            at = pa.array(row)
            first = batch.column(3).to_numpy().astype(np.int64)[row] + place
            yield pa.RecordBatch.from_arrays([pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), batch.column(2).take(at), batch.column(1).take(at), pa.array(first.astype(np.int32))], ["d1", "d2", "doc_id", "cls", "a"])

    windows = sent.select("mini", "cls", "doc_id", "first", "packed").mapInArrow(explode, "d1 bigint, d2 bigint, doc_id bigint, cls binary, a int")
    least = windows.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    return windows.join(least, ["d1", "d2"]).where(F.col("doc_id") > F.col("least")).select("doc_id", "cls", "a", (F.col("a") + width).alias("b"))


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, mer: int = MER, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and text (the kept words joined by one space).

    A word is removed if a window of ``width`` consecutive words that covers it also starts
    in a document with a smaller id; windows are judged on the input.  A null or empty text
    has no words.  Texts with fewer words than a window stay as they are.  Rows that share an
    id are no smaller than each other, so none of them loses words to another.  A null id
    counts as larger than all others.  An empty table gives an empty result; other columns
    are ignored.
    """
    if not 1 <= mer <= width:
        raise ValueError("a minimiser has between 1 word and the words of a window")
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    _, spans = repeated_spans(source, width, mer, hot)
    spans = stored(spans.groupBy("doc_id", "cls").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    bits = blooms.bits_for(spans.count(), 16)
    held = spark.sparkContext.broadcast(blooms.membership(spans.select("doc_id").where("doc_id is not null"), bits))
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string"

    def ids_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = blooms.Filter(bits, held.value)
        for batch in pieces(batches):
            rest = batch.filter(pa.array(~known.has(ids_of(batch))))
            yield _kept(rest.column(0), _words(rest.column(1)), [None] * rest.num_rows)

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = blooms.Filter(bits, held.value)
        for batch in pieces(batches):
            some = batch.filter(pa.array(known.has(ids_of(batch))))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([_class(w) for w in _words(some.column(1))], pa.binary())], ["doc_id", "text", "cls"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield _kept(batch.column(0), _words(batch.column(1)), batch.column(2).to_pylist())

    some = source.mapInArrow(suspected, "doc_id bigint, text string, cls binary")
    own = spans.withColumnsRenamed({"doc_id": "d", "cls": "c"})
    some = some.join(own, (F.coalesce(some["doc_id"], F.lit(LAST)) == own["d"]) & (some["cls"] == own["c"]), "left").select("doc_id", "text", "spans")
    return source.mapInArrow(untouched, out).unionByName(some.mapInArrow(cut, out))


def _kept(ids: pa.Array, texts: list[list[bytes]], spans: list) -> pa.RecordBatch:
    n, removed, sums, kept = [], [], [], []
    for words, own in zip(texts, spans, strict=True):
        stay = words
        if own:
            stay, at = [], 0
            for s in sorted((s["a"], s["b"]) for s in own):
                if s[0] > at:
                    stay += words[at : s[0]]
                at = max(at, s[1])
            stay += words[at:]
        joined = b" ".join(stay)
        n.append(len(words))
        removed.append(len(words) - len(stay))
        sums.append(hashlib.sha256(joined).hexdigest())
        kept.append(joined.decode())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])
