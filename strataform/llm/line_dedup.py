"""Line dedup with two Bloom filters.

A first pass fills a filter of line hashes seen once and one of those seen twice, for
each partition, and merges them in a tree.  Only lines that the second filter suspects
are shuffled, as 128-bit digests, to be counted exactly and, where one document is to
keep a line, to choose its first occurrence.  The filters have a bounded size: beyond it
more lines are suspected and shuffled, and the result stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import blooms
from .common import bound_batches, encoded, pieces, stored

#: At most so many repeated keys are broadcast, 16 bytes each in a sorted array; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: With their first rows, which are no numbers, so many at most.
MOST_FIRSTS = 100_000


def line_key(line: bytes) -> bytes:
    """The line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased."""
    return line.strip().lower()


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class Keys:
    """A set of 128-bit digests as two sorted arrays."""

    def __init__(self, digests: list[bytes]) -> None:
        both = np.sort(np.frombuffer(b"".join(digests), np.dtype([("a", ">u8"), ("b", ">u8")])), order=("a", "b"))
        self.a, self.b = both["a"].astype(np.uint64), both["b"].astype(np.uint64)
        #: Digests that share their first half, at most.
        self.run = int(np.unique(self.a, return_counts=True)[1].max(initial=0))

    def has(self, digests: list[bytes]) -> np.ndarray:
        a, b = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2).T
        out = np.zeros(len(a), bool)
        at = np.searchsorted(self.a, a)
        for k in range(self.run):
            here = np.minimum(at + k, len(self.a) - 1)
            out |= (self.a[here] == a) & (self.b[here] == b)
        return out


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in encoded(batch.column(column)):
        yield text or b""


def _keys(text: bytes, least: int) -> set[bytes]:
    found = {k for k in map(line_key, text.split(b"\n")) if k}
    return found if least <= 1 else {k for k in found if len(k.decode()) >= least}


def _suspect_filter(source: DataFrame, least: int, bits: int | None) -> tuple[bytes, int]:
    lines = source.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 0
    bits = bits or blooms.bits_for(int(lines))

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in _texts(batch, 0):
            yield np.array([xxhash.xxh3_64_intdigest(k) for k in _keys(text, least)], np.uint64)

    return blooms.repeated(source.select("text"), hashes_of, bits), bits


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, bits: int | None = None, order_col: str | None = None) -> DataFrame:
    """key (128-bit digest), n_docs and first_doc (least id, or ``order_col``) of the line keys found in ``min_docs`` rows or more."""
    source = _source(docs, id_col, text_col, order_col)
    twice, bits = _suspect_filter(source, min_chars, bits)
    held = source.sparkSession.sparkContext.broadcast(twice)
    kind = source.schema["place"].dataType.simpleString()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = blooms.Filter(bits, held.value)
        for batch in pieces(batches):
            rows, keys = [], []
            for row, text in enumerate(_texts(batch, 1)):
                own = list(_keys(text, min_chars))
                if own:
                    hit = known.has(np.array([xxhash.xxh3_64_intdigest(k) for k in own], np.uint64))
                    for k in np.flatnonzero(hit):
                        rows.append(row)
                        keys.append(digest(own[k]))
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary())], ["place", "key"])

    found = source.mapInArrow(suspects, f"place {kind}, key binary")
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("place").alias("first_doc")).where(F.col("n_docs") >= min_docs)


def _source(docs: DataFrame, id_col: str, text_col: str, order_col: str | None) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(order_col or id_col).alias("place"))


def _plain(value):
    """A collected value as Arrow gives it: structs are dicts."""
    return value.asDict(recursive=True) if isinstance(value, Row) else value


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep: str = "none",
    bits: int | None = None,
    most_broadcast: int = MOST_BROADCAST,
    order_col: str | None = None,
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and text (the kept lines joined by ``\\n``).

    A text is split at ``\\n``; a null or empty text is one empty line.  The key of a line is
    the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z in lower case.  Keys of at least
    ``min_chars`` code points that occur in ``min_docs`` rows or more lose all their lines
    (``keep="none"``) or all but those in the smallest document id (``keep="first"``).  Where ids
    repeat, ``order_col`` (a value of its own for each row) says which row is the first.

    A row counts as a document, so repeated rows count each; null ids are kept.  Texts of any
    length are used whole, an empty table gives an empty result, and other columns are
    ignored.  Null texts give an empty kept text.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    source = _source(docs, id_col, text_col, order_col)
    spark = source.sparkSession
    bound_batches(spark)
    heavy = stored(repeated_lines(source, min_docs=min_docs, min_chars=min_chars, bits=bits, order_col="place"), "lines")
    kind = source.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string, text string"
    n = heavy.count()
    if keep == "none" and n <= most_broadcast:
        sent = spark.sparkContext.broadcast([bytes(r["key"]) for r in heavy.select("key").toLocalIterator()])

        def apply_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Keys(sent.value)
            for batch in pieces(batches):
                texts = [t.split(b"\n") for t in _texts(batch, 1)]
                keys = [line_key(line) for lines in texts for line in lines]
                some = [k for k, key in enumerate(keys) if key and (min_chars <= 1 or len(key.decode()) >= min_chars)]
                gone = np.zeros(len(keys), bool)
                gone[some] = known.has([digest(keys[k]) for k in some])
                yield _kept(batch.column(0), texts, gone.tolist())

        return source.mapInArrow(apply_all, out)
    if keep == "first" and n <= min(most_broadcast, MOST_FIRSTS):
        known = spark.sparkContext.broadcast({bytes(r["key"]): _plain(r["first_doc"]) for r in heavy.toLocalIterator()})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = known.value
            for batch in pieces(batches):
                yield _rewritten(batch.column(0), _texts(batch, 1), batch.column(2).to_pylist(), lambda k, d: k in first and first[k] != d, min_chars)

        return source.mapInArrow(apply, out)

    # Too many keys to send to every worker: bring each document its own by a shuffle.
    keyed = source.withColumn("h", F.xxhash64("text"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, keys = [], []
            for row, text in enumerate(_texts(batch, 1)):
                for k in _keys(text, min_chars):
                    rows.append(row)
                    keys.append(digest(k))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (0, 2, 3)), pa.array(keys, pa.binary())], ["doc_id", "place", "h", "key"])

    order = source.schema["place"].dataType.simpleString()
    marks = keyed.mapInArrow(explode, f"doc_id {kind}, place {order}, h bigint, key binary").join(heavy, "key")
    if keep == "first":
        marks = marks.where(~F.col("first_doc").eqNullSafe(F.col("place")))
    marks = marks.groupBy(F.col("doc_id").alias("d"), F.col("place").alias("p"), F.col("h").alias("g")).agg(F.collect_set("key").alias("dropped"))
    both = keyed.join(marks, keyed["doc_id"].eqNullSafe(marks["d"]) & keyed["place"].eqNullSafe(marks["p"]) & (keyed["h"] == marks["g"]), "left").select("doc_id", "text", "dropped")

    def apply_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = [set(x or ()) for x in batch.column(2).to_pylist()]
            yield _rewritten(batch.column(0), _texts(batch, 1), own, lambda k, mine: k in mine, min_chars)

    return both.mapInArrow(apply_own, out)


def _rewritten(ids: pa.Array, texts: Iterator[bytes], context: list, drops, least: int) -> pa.RecordBatch:
    split, gone = [], []
    for text, mine in zip(texts, context, strict=True):
        split.append(text.split(b"\n"))
        for line in split[-1]:
            key = line_key(line)
            gone.append(bool(key) and (least <= 1 or len(key.decode()) >= least) and drops(digest(key), mine))
    return _kept(ids, split, gone)


def _kept(ids: pa.Array, texts: list[list[bytes]], gone: list[bool]) -> pa.RecordBatch:
    """What is left of the lines of some texts; ``gone`` tells of all lines one after the other."""
    n_lines, n_dropped, sums, kept, at = [], [], [], [], 0
    for lines in texts:
        own = gone[at : at + len(lines)]
        at += len(lines)
        stay = [line for line, out in zip(lines, own, strict=True) if not out] if any(own) else lines
        joined = b"\n".join(stay)
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(stay))
        sums.append(hashlib.sha256(joined).hexdigest())
        kept.append(joined)
    return pa.RecordBatch.from_arrays([ids, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sums, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "text"])
