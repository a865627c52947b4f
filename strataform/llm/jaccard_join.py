"""Exact n-gram Jaccard join with rare-first prefix filtering.

Sets are the distinct word shingles of texts.  Texts with equal sets are one vertex, known
by the digest of the set.  Two vertices link when their Jaccard similarity reaches the
threshold t.  The steps:

1. *Liveness.*  A linked pair shares at least l of the first ``n - ceil(t n) + l`` shingles
   of either set in any common order.  In the order of hashes that needs no statistics, so a
   first pass over these prefixes alone rules out most texts: a set stays alive if at least
   l of its prefix shingles are met in another set.  They travel packed, twelve bytes each.
2. *Rare-first prefixes.*  For live sets only, a count sketch of bounded size gives the
   order: rare shingles first, ties by hash.  Any fixed order is correct; a coarser sketch
   makes longer candidate lists.  Shingles counted once cannot match and are not sent.
3. *Candidates.*  Prefix shingles meet by an equi-join.  A group of near copies shares most
   of its prefix, so pairs are not listed at once: in each round every vertex is compared
   with one pivot of each of its shingles, links found are contracted into components, and
   only shingles that still hold several components go on.  What remains at the end is
   joined across components, under the length and positional filters, in bands of sizes.
4. *Verification.*  Each pair once: the suffix filter bounds the overlap by sixteen-way
   counts, then the sets are intersected exactly.

``jaccard_links`` gives every link: all candidates go to verification, none is contracted.
``jaccard_components`` needs no link inside a component that other links already join, and
leaves those out through the pivot rounds of step 3.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import blooms
from .common import bound_batches, cleared, encoded, partitions, pieces, removed, scratch_path, stored, tree_merge
from .words import hashed, shingles

#: A count sketch has at most so many one-byte cells (32 MB).
MOST_CELLS = 1 << 25


#: Bytes of text for each bucket of the liveness pass: about a million prefix shingles.
BUCKET_BYTES = 24 << 20
LEAST_BUCKETS = 32
#: Prefix shingles that a task gathers before it sends them, and that a bucket sorts at once.
GATHERED, SORTED = 1 << 19, 1 << 21
LOW48 = np.uint64((1 << 48) - 1)


def _sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    return shingles(*hashed([t.lower().split() if t else [] for t in texts]), width)


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _packed(x: np.ndarray) -> np.ndarray:
    """Six bytes of each number below 2**48."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


class Gathered:
    """Prefix shingles of some sets of a task, to be sent to their buckets in one packed row each."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.tokens: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.need: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, owner: int, prefix: np.ndarray, need: int, text: int) -> None:
        self.tokens.append(prefix)
        self.owners.append(np.full(len(prefix), owner, np.uint64))
        self.need.append((owner, need, text))
        self.size += len(prefix)

    def rows(self, row_type: pa.DataType) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Packed shingles by bucket, and the sets with what they need and already share in here.

        A shingle of one set goes with its owner, one of several sets once, without an owner.
        """
        t = np.concatenate(self.tokens) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(t)
        t, o = t[order], np.concatenate(self.owners)[order]
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        last = np.append(new[1:], True)
        owner, got = np.unique(o[~(new & last)], return_counts=True)
        alone = (new & last)[new]
        t, o = t[new], np.where(alone, o[new], np.uint64(0))
        bucket = (t >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        cut = np.searchsorted(bucket, np.arange(self.buckets + 1, dtype=np.uint64)).astype(np.int64)
        full = np.flatnonzero(np.diff(cut))
        at = pa.py_buffer((6 * np.append(cut[full], len(t))).astype(np.int32))
        blob = lambda x: pa.Array.from_buffers(pa.binary(), len(full), [None, at, pa.py_buffer(_packed(x))])
        sent = _filled({"kind": pa.array(np.ones(len(full), np.int8)), "bucket": pa.array(full.astype(np.int32)), "tokens": blob(t & LOW48), "owners": blob(o)}, len(full), row_type)
        names, need, text = (np.array(x, np.uint64) for x in zip(*self.need, strict=True))
        place = np.minimum(np.searchsorted(owner, names), max(0, len(owner) - 1))
        have = np.where(owner[place] == names, got[place], 0) if len(owner) else np.zeros(len(names), np.int64)
        own = _filled({"kind": pa.array(np.full(len(names), 2, np.int8)), "owner": pa.array(names.view(np.int64)), "text_hash": pa.array(text.view(np.int64)), "got": pa.array(have.astype(np.int64)), "need": pa.array(need.astype(np.int64))}, len(names), row_type)
        self.clear()
        return sent, own


#: Columns of the first pass; kind 0: a row of the table, 1: packed shingles of a bucket, 2: a set of a task.
_FIRST = {"doc_id": "bigint", "n": "bigint", "cls": "binary", "row": "bigint", "bucket": "int", "tokens": "binary", "owners": "binary", "owner": "bigint", "text_hash": "bigint", "got": "bigint", "need": "bigint", "kind": "tinyint"}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "binary": pa.binary()}


def _filled(columns: dict[str, pa.Array], n: int, row_type: pa.DataType) -> pa.RecordBatch:
    kinds = {c: _ARROW[k] for c, k in _FIRST.items()} | {"row": row_type}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in kinds.items()], list(kinds))


def _text_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _described(numbered: DataFrame, width: int, percent: int, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, cls, row), and hashes of the texts whose sets have enough shared shingles in their prefixes.

    One pass over the texts gives both.  Its packed shingles meet in buckets by hash; digests
    of 48 bits only ever let more sets through.  Of equal sets one text is named.
    """
    spark = numbered.sparkSession
    size = numbered.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    row = numbered.schema["row"].dataType
    row_type, ddl = to_arrow_type(row), ", ".join(f"{c} {k}" for c, k in (_FIRST | {"row": row.simpleString()}).items())
    buckets = min(1 << 16, max(LEAST_BUCKETS, partitions(spark), -(-int(size) // BUCKET_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held = Gathered(buckets)
        for batch in pieces(batches):
            texts = encoded(batch.column(1))
            sets = _sets(texts, width)
            keys = [_digest(s) if len(s) else None for s in sets]
            yield _filled({"kind": pa.array(np.zeros(len(sets), np.int8)), "doc_id": batch.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "cls": pa.array(keys, pa.binary()), "row": batch.column(2)}, len(sets), row_type)
            for text, key, values in zip(texts, keys, sets, strict=True):
                if key is not None and key not in seen:
                    seen.add(key)
                    n = len(values)
                    least = 1 + n // 20
                    held.add(int.from_bytes(key[:6], "little") or 1, values[: min(n, n - -(-percent * n // 100) + least)], least, _text_hash(text))
            if held.size >= GATHERED:
                yield from held.rows(row_type)
        if held.size:
            yield from held.rows(row_type)

    path = scratch_path(spark, "first")
    numbered.mapInArrow(run, ddl).write.partitionBy("kind").parquet(path)
    first = spark.read.schema(ddl).parquet(path)
    rows = first.where("kind = 0").select("doc_id", "n", "cls", "row")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners = [], []
        for batch in batches:
            for t, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens.append(_unpacked(t))
                owners.append(_unpacked(o))
        if not tokens:
            return
        t, o = np.concatenate(tokens), np.concatenate(owners)
        del tokens, owners
        turns = np.uint64(len(t) // SORTED + 1)
        for turn in range(int(turns)):
            own = (t * turns >> np.uint64(48)) == np.uint64(turn) if turns > 1 else slice(None)
            found = _shared(t[own], o[own])
            if len(found):
                owner, got = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(owner.view(np.int64)), pa.array(got.astype(np.int64))], ["owner", "got"])

    blobs = first.where("kind = 1").select("bucket", "tokens", "owners")
    found = blobs.repartitionById(buckets, "bucket").mapInArrow(meet, "owner bigint, got bigint")
    none = F.lit(None).cast("bigint")
    own = first.where("kind = 2").select("owner", "got", "need", "text_hash")
    both = found.select("owner", "got", none.alias("need"), none.alias("text_hash")).unionByName(own)
    live = both.groupBy("owner").agg(F.sum("got").alias("got"), F.min("need").alias("need"), F.min("text_hash").alias("text_hash")).where("got >= need").select("text_hash")
    live = stored(live, "live", scratch)
    removed(spark, f"{path}/kind=1")
    return rows, live


def _shared(t: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Owners of the shingles that several sets have stated, once for each such shingle; 0 stands for several at once."""
    order = np.argsort(t)
    t, o = t[order], o[order]
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return o
    lo, hi = np.minimum.reduceat(o, at), np.maximum.reduceat(o, at)
    hit = np.repeat((lo == 0) | (lo != hi), np.diff(np.append(at, len(t)))) & (o != 0)
    t, o = t[hit], o[hit]
    order = np.lexsort((o, t))
    t, o = t[order], o[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    return o[new]


def _sketch(tokens: DataFrame, cells: int, kind: str) -> bytes:
    """How often hashes fall in each cell, up to the largest number of the kind."""
    most = int(np.iinfo(kind).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, kind)
        for batch in pieces(batches, 2000):
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            cell, n = np.unique(values & np.uint64(cells - 1), return_counts=True)
            cell = cell.astype(np.int64)
            total[cell] = np.minimum(total[cell].astype(np.int64) + n, most)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["sketch"])

    def add(a: bytes, b: bytes) -> bytes:
        x, y = (np.frombuffer(zlib.decompress(p), kind) for p in (a, b))
        z = x + y
        z[z < x] = most
        return zlib.compress(z.tobytes(), 1)

    merged = tree_merge(tokens.mapInArrow(run, "sketch binary"), "sketch", add, cells * np.dtype(kind).itemsize)
    return bytes(cells * np.dtype(kind).itemsize) if merged is None else zlib.decompress(merged)


def _cells(total: int) -> tuple[int, str]:
    """Number and kind of the cells for so many shingles: narrow ones while cells are few a shingle, then wide ones, which still tell the frequent from the rest."""
    if total <= 64 * MOST_CELLS:
        return min(MOST_CELLS, max(1 << 16, 1 << (4 * total).bit_length())), "u1"
    return MOST_CELLS // 4, "<u4"


def _reaches(a: Column, b: Column, common: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _may_link(n: Column, place: Column, other_n: Column, other_place: Column, percent: int) -> Column:
    """Length and positional filter for two sets that meet in a shingle at these places.

    If it is the first that both share, no more can be shared than follow it in either set.
    A linked pair passes at its first common shingle, whatever happens at later ones.
    """
    length = 100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)
    return length & _reaches(n, other_n, 1 + F.least(n - place, other_n - other_place), percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, sift: bool = True) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, with the sizes na and nb and the common shingles.

    Sets lie in buckets by v, so the first join moves pairs only and the second the set of a.
    Where many pairs will fail, ``sift`` applies the suffix filter before any set is moved.
    """
    pairs = pairs.select("a", "b")
    side = lambda c, *columns: sets.select(F.col("v").alias(c), *(F.col(x).alias(x + c) for x in columns))
    bound = F.aggregate(F.zip_with("partsa", "partsb", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    may = _reaches(F.col("na"), F.col("nb"), bound, percent)
    if sift:
        pairs = pairs.join(side("a", "n", "parts"), "a").join(side("b", "n", "parts"), "b").where(may).select("a", "b")
    both = pairs.join(side("a", "n", "tokens", "parts"), "a").join(side("b", "n", "tokens", "parts"), "b")
    common = F.when(may, F.size(F.array_intersect("tokensa", "tokensb"))).otherwise(F.lit(-1))
    return both.select("a", "b", "na", "nb", common.alias("common")).where((F.col("common") >= 0) & _reaches(F.col("na"), F.col("nb"), F.col("common"), percent))


def components(edges: DataFrame, vertices: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """v and label, the smallest vertex that ``edges`` (a, b) reach; every round is written out."""
    labels = stored(vertices.select("v", F.col("v").alias("label")), "labels", scratch)
    edges = stored(edges.select("a", "b"), "edges", scratch)
    while True:
        at_a = edges.join(labels.select(F.col("v").alias("a"), F.col("label").alias("la")), "a")
        both = at_a.join(labels.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
        # Hook the larger of two labels under the smallest that it meets, then shorten the paths.
        hooks = both.select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("to")).groupBy("label").agg(F.min("to").alias("to"))
        hooks = stored(hooks, "hooks", scratch)
        if hooks.limit(1).count() == 0:
            return labels
        while True:
            ahead = hooks.select(F.col("label").alias("to"), F.col("to").alias("further"))
            jumped = stored(hooks.join(ahead, "to", "left").select("label", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "hooks", scratch)
            hooks = jumped.select("label", "to")
            if jumped.where("moved").limit(1).count() == 0:
                break
        labels = stored(labels.join(hooks, "label", "left").select("v", F.coalesce("to", "label").alias("label")), "labels", scratch)


@dataclass
class Prepared:
    """Rows (doc_id, n, cls, row), classes (cls, rep), sets that may link (v, cls, n, tokens, parts) and their prefix entries."""

    rows: DataFrame
    classes: DataFrame
    sets: DataFrame
    entries: DataFrame
    name: str
    scratch: list[str]

    def clear(self) -> None:
        spark = self.rows.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        cleared(spark, self.scratch)


def _vertices(found: DataFrame, scratch: list[str]) -> tuple[DataFrame, str]:
    """The distinct sets with a number v each, written in buckets by v, so that joins on v do not move them.

    v is a keyed hash of the class; should two classes have one, the next key is taken.
    """
    spark, seed = found.sparkSession, 0
    while True:
        path, name = scratch_path(spark, "vertices"), f"strataform_vertices_{uuid.uuid4().hex}"
        # Several tasks may have met one class; one copy of its set is enough.
        one = found.withColumn("v", F.xxhash64(F.lit(seed), "cls")).groupBy("v").agg(F.first("cls").alias("cls"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("parts").alias("parts"), (F.min("cls") != F.max("cls")).alias("clash"))
        one.write.bucketBy(partitions(spark), "v").sortBy("v").format("parquet").option("path", path).saveAsTable(name)
        scratch.append(path)
        sets = spark.table(name)
        if not sets.where("clash").limit(1).count():
            return sets.drop("clash"), name
        spark.sql(f"DROP TABLE {name}")
        seed += 1


def _prepared(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, row_col: str | None = None) -> Prepared:
    if not 0 < percent <= 100:
        raise ValueError("the threshold is above 0 and at most 100 per cent")
    spark, scratch = docs.sparkSession, []
    bound_batches(spark)
    numbered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(row_col) if row_col else F.lit(None).cast("long")).alias("row"))
    rows, live = _described(numbered, width, percent, scratch)
    known = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min(known).alias("rep"))
    bits = blooms.bits_for(live.count(), 16)
    held = spark.sparkContext.broadcast(blooms.membership(live, bits))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        known = blooms.Filter(bits, held.value)
        for batch in pieces(batches):
            texts = [t for t in encoded(batch.column(0)) if t]
            hashes = np.fromiter(map(_text_hash, texts), np.uint64, len(texts))
            some = []
            for k in np.flatnonzero(known.has(hashes)).tolist():
                if (h := int(hashes[k])) not in seen:
                    seen.add(h)
                    some.append(texts[k])
            sets = [s for s in _sets(some, width) if len(s)]
            if not sets:
                continue
            sizes = np.array([len(s) for s in sets], np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            parts = [np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=16).astype(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array(sizes), tokens, pa.array(parts, pa.list_(pa.int32()))], ["cls", "n", "tokens", "parts"])

    found = numbered.select("text").mapInArrow(collect, "cls binary, n int, tokens array<bigint>, parts array<int>")
    sets, name = _vertices(found, scratch)
    cells, kind = _cells(int(sets.agg(F.sum("n").alias("t")).first()["t"] or 0))
    counts = spark.sparkContext.broadcast(_sketch(sets.select("tokens"), cells, kind))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(counts.value, kind)
        for batch in pieces(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            owners: list[int] = []
            for row, (n, cell) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                values = cell.values.to_numpy(zero_copy_only=False).view(np.uint64)
                often = table[(values & np.uint64(cells - 1)).astype(np.int64)]
                order = np.lexsort((values, often))
                keep = order[: n - -(-percent * n // 100) + 1]
                lone = int((often <= 1).sum())
                some = often[keep] > 1
                k = int(some.sum())
                owners.extend([row] * k)
                for column, x in zip(out, (values[keep][some].view(np.int64), np.full(k, n, np.int32), np.arange(1, len(keep) + 1)[some], np.full(k, lone, np.int32)), strict=True):
                    column.append(x)
            token, size, place, lone_ = (np.concatenate(x) for x in out)
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(x.astype(np.int32)) for x in (size, place, lone_))], ["token", "v", "n", "place", "lone"])

    entries = stored(sets.select("v", "n", "tokens").mapInArrow(prefixes, "token bigint, v bigint, n int, place int, lone int"), "prefixes", scratch)
    return Prepared(rows, classes, sets, entries, name, scratch)


def _named(c: Column, own: Column) -> Column:
    """A smallest document, null where it has a null id; ``own`` for rows without a set."""
    return F.coalesce(F.when(c == (1 << 63) - 1, F.lit(None).cast("long")).otherwise(c), own)


def _band(n: Column, percent: int) -> Column:
    """Sets link only within a band of sizes or with the next one."""
    return n.cast("int") if percent == 100 else F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def _met(entries: DataFrame, percent: int, *apart: str) -> DataFrame:
    """The pairs (a, b), a below b, that share a prefix shingle within the filters and differ in the columns ``apart``.

    Sets meet in a shingle and a band of sizes, the smaller of the two (or of equal size) in
    its own band or one below, so that a shingle of very many sets is several keys.
    """
    one, two = (entries.select("token", *(F.col(c).alias(c + s) for c in ("v", "n", "place", *apart))) for s in ("1", "2"))
    band = _band(F.col("n1"), percent)
    one = one.withColumn("band", F.explode(F.array(band) if percent == 100 else F.array(band, band + 1)))
    two = two.withColumn("band", _band(F.col("n2"), percent))
    # The filters are part of the join, so that pairs they rule out are never made.
    meet = (one["token"] == two["token"]) & (one["band"] == two["band"]) & ((F.col("n1") < F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("v1") < F.col("v2")))
    for c in apart:
        meet = meet & (F.col(c + "1") != F.col(c + "2"))
    meet = meet & _may_link(F.col("n1"), F.col("place1"), F.col("n2"), F.col("place2"), percent)
    return one.join(two, meet).select(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b")).distinct()


def jaccard_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links, and the rows' membership; sets, nulls and repeated ids are as in ``jaccard_components``.

    The first table has each pair of different sets that reaches the threshold once: the
    classes a < b (digests of the sets), a_vertex and b_vertex (smallest documents), na, nb and
    common.  The second has one row per row of ``docs``: doc_id, n_shingles, cls, vertex and
    n_links, the number of other rows whose set is equal or linked.  Rows of one class are
    linked with each other through it, so a group of copies adds no pairs; a row without
    words has no class and no links.  The links grow with what there is to list: near copies
    with different texts are all paired.
    """
    found = _prepared(docs, id_col, text_col, width, percent, None)
    rows, classes, scratch = found.rows, found.classes, found.scratch
    links = stored(_verified(_met(found.entries, percent), found.sets, percent), "links", scratch)
    named = lambda c: found.sets.select(F.col("v").alias(c), F.col("cls").alias(f"cls_{c}"))
    links = stored(links.join(named("a"), "a").join(named("b"), "b"), "links", scratch)
    swap = F.col("cls_a") > F.col("cls_b")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    links = links.select(either("cls_a", "cls_b").alias("a"), either("cls_b", "cls_a").alias("b"), either("na", "nb").alias("na"), either("nb", "na").alias("nb"), "common")
    sized = stored(rows.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("n_rows")).join(classes, "cls"), "sized", scratch)
    at = lambda c, vertex: sized.select(F.col("cls").alias(c), F.col("rep").alias(vertex), F.col("n_rows").alias(f"rows_{c}"))
    both = stored(links.join(at("a", "a_vertex"), "a").join(at("b", "b_vertex"), "b"), "linked")
    ends = both.select(F.col("a").alias("cls"), F.col("rows_b").alias("m")).unionByName(both.select(F.col("b").alias("cls"), F.col("rows_a").alias("m")))
    counted = sized.join(ends.groupBy("cls").agg(F.sum("m").alias("m")), "cls", "left").select("cls", "rep", (F.col("n_rows") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    counted = stored(counted, "counted")
    own = F.when(F.col("cls").isNull(), F.col("doc_id"))
    members = rows.join(counted, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), "cls", _named(F.col("rep"), own).alias("vertex"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    none = F.lit(None).cast("long")
    found.clear()
    return both.select("a", "b", _named(F.col("a_vertex"), none).alias("a_vertex"), _named(F.col("b_vertex"), none).alias("b_vertex"), "na", "nb", "common"), members


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rounds: int = 8, row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and vertex, one row per row of ``docs``.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``.  A set is the distinct
    ``width``-word shingles of a text, or all its words as one shingle if it has fewer.  A null
    text, or one without words, has an empty set and links with nothing.  ``vertex`` is the
    smallest document with the same set, ``component_id`` the smallest that links reach.
    Rows that share an id stay separate rows and each is linked by its own text; a null id
    counts as larger than all others and comes back as a null id.  An empty table gives an
    empty result; other columns are ignored.  ``label`` names the component itself, as ids may
    repeat, and ``row`` is the value of ``row_col``.  At most ``rounds`` pivot rounds, while
    they link much, come before the remaining pairs across components are listed; they only
    decide what that costs.
    """
    found = _prepared(docs, id_col, text_col, width, percent, row_col)
    sets, scratch = found.sets, found.scratch
    marked = found.entries.withColumn("label", F.col("v"))
    moved = tried = None
    for turn in range(rounds):
        # The pivot of a shingle: first the set that shares most of itself, in later rounds any.
        order = F.col("lone").cast("bigint") if turn == 0 else F.xxhash64("v", F.lit(turn))
        shared = marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(order.alias("order"), "v", "n", "place", "label")).alias("p")).where("lo <> hi")
        marked = stored(marked.join(shared.select("token", "p"), "token"), "open", scratch)
        star = marked.where((F.col("label") != F.col("p.label")) & _may_link(F.col("n"), F.col("place"), F.col("p.n"), F.col("p.place"), percent))
        star = star.groupBy(F.col("v").alias("a"), F.col("p.v").alias("b")).agg(F.count(F.lit(1)).alias("c"))
        if tried is not None:
            star = star.join(tried, ["a", "b"], "left_anti")
        # Each set meets the one pivot that most of its shingles name, so no round moves a set twice.
        pairs = star.groupBy("a").agg(F.max(F.struct("c", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
        pairs = stored(pairs, "pairs", scratch)
        links = stored(_verified(pairs, sets, percent, sift=False).select("a", "b"), "links", scratch)
        both_ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = both_ways if tried is None else stored(tried.unionByName(both_ways), "tried", scratch)
        linked = links.count()
        if linked:
            moved = _moved(moved, links, scratch)
            marked = marked.drop("p", "label").join(moved, "v", "left").withColumn("label", F.coalesce("label", "v"))
        if 50 * linked <= pairs.count():
            break
    rest = _met(marked.select("token", "v", "n", "place", "label"), percent, "label")
    if tried is not None:
        rest = rest.join(tried, ["a", "b"], "left_anti")
    links = stored(_verified(rest, sets, percent).select("a", "b"), "links", scratch)
    if moved is None or links.limit(1).count():
        moved = _moved(moved, links, scratch)
    # Classes take the smallest document of their component, then rows that of their class.
    moved = moved.join(sets.select("v", "cls"), "v").drop("v")
    moved = moved.join(sets.select(F.col("v").alias("label"), F.col("cls").alias("to")), "label").select("cls", "to")
    joined = stored(found.classes.join(moved, "cls", "left").select("cls", "rep", F.coalesce("to", "cls").alias("label")), "joined")
    found.clear()
    least = joined.groupBy("label").agg(F.min("rep").alias("component"))
    named = found.rows.join(joined.join(least, "label").select("cls", "rep", "component", "label"), "cls", "left")
    own = F.when(F.col("cls").isNull(), F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), _named(F.col("component"), own).alias("component_id"), _named(F.col("rep"), own).alias("vertex"), "cls", "label", "row")


def _moved(moved: DataFrame | None, links: DataFrame, scratch: list[str]) -> DataFrame:
    """v and label of the vertices that another one stands for, after the links (a, b) have been contracted.

    A vertex that is not listed stands for itself.
    """
    if moved is None:
        edges = links
    else:
        of = lambda c: moved.select(F.col("v").alias(c), F.col("label").alias(f"l{c}"))
        ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        edges = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    edges = stored(edges, "edges", scratch)
    ends = edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).distinct()
    new = components(edges, ends, scratch).where("v <> label")
    if moved is None:
        return new
    kept = moved.join(new.select(F.col("v").alias("label"), F.col("label").alias("to")), "label", "left").select("v", F.coalesce("to", "label").alias("label"))
    return stored(kept.unionByName(new), "moved", scratch)
