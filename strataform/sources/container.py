"""Containers: versioned, checksummed tables with selective reads and a manifest.

A container is a folder::

    manifest.json                 written last, by rename: it names the version that counts
    <version>/data/<object>/      Parquet, sorted by __row, with page checksums
    <version>/blocks/             object_id, blk, n and digest of each block of rows

The manifest holds what inspection needs (schemas, counts, attributes, metadata, hashes), so
that no inspection reads data.  A writer that dies leaves a folder that no manifest names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import pickle
import struct
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__, options
from ..errors import ArgumentError, CodecError, FormatError, LimitError, StorageError, UnsupportedError, VersionError
from ..functions.exprs import div
from ..operators import graph, guards, hashing, rows
from . import directory as directories
from .storage import Store

FORMAT = 1
ROW = "__row"
NAME = "__name"
BLOCK = 65_536
#: Seconds after which a version that no manifest names is taken for a dead writer's.
GRACE = 7 * 24 * 3600
#: The limits of metadata, and of a chunk of an opaque value.
MOST_KEYS, MOST_METADATA, CHUNK = 1024, 65_536, 1 << 20
SYNOPSIS_NAMES, SYNOPSIS_BYTES = 64, 256


def check_metadata(metadata: dict[str, str] | None) -> dict[str, str]:
    """The metadata, if all keys and values are text without NUL, keys are not empty, and limits hold."""
    out = dict(metadata or {})
    for k, v in out.items():
        if not isinstance(k, str) or not isinstance(v, str) or not k or "\0" in k or "\0" in v:
            raise ArgumentError("metadata has distinct, non-empty text keys and text values without NUL")
    if len(out) > MOST_KEYS or sum(len(k.encode()) + len(v.encode()) for k, v in out.items()) > MOST_METADATA:
        raise LimitError(f"metadata has at most {MOST_KEYS} entries and {MOST_METADATA} bytes")
    return out


def _level(compress: int) -> int:
    if isinstance(compress, bool) or compress != int(compress) or not 0 <= compress <= 19:
        raise ArgumentError("the compression level is from 0 to 19")
    return int(compress)


def _ordered(df: DataFrame, row: str | None, order: Sequence[str] | None) -> DataFrame:
    """The table with its positions in ``__row``; without a column of them or an order, rows count as they are found."""
    if row is not None:
        return df.withColumn(ROW, F.col(f"`{row}`").cast("bigint"))
    return rows.number(df, list(order or ()), ROW)


def table_hash(df: DataFrame, *, row: str | None = None, order: Sequence[str] | None = None, block: int = BLOCK) -> str:
    """64 hexadecimal digits over types, names, values and order; not over partitions or encodings."""
    held = _ordered(df, row, order)
    return _table_hash(df, hashing.block_digests(held, df.columns, ROW, block))


def _table_hash(df: DataFrame, blocks: DataFrame) -> str:
    root = hashing.root_digest(blocks).first()
    head = json.dumps([[f.name, f.dataType.simpleString(), f.metadata.get("attributes", {})] for f in df.schema.fields])
    return hashlib.sha256(f"{head}|{root['n'] if root else 0}|{root['digest'] if root else ''}".encode()).hexdigest()


def write(
    value: DataFrame | dict[str, DataFrame] | Any,
    path: str,
    *,
    spark: SparkSession | None = None,
    row: str | None = None,
    order: Sequence[str] | dict[str, Sequence[str]] | None = None,
    metadata: dict[str, str] | None = None,
    attributes: dict[str, Any] | None = None,
    compress: int | None = None,
    hash: bool | None = None,
    skip_unchanged: bool = False,
    mode: str = "auto",
    share: bool = False,
    block: int | None = None,
    directory: bool = False,
    row_names: str | None = None,
) -> str:
    """Writes a table, a named archive of tables or, with ``mode="auto"``, any other value as an opaque payload.

    ``row`` names a column of positions; else rows are in the order of the columns ``order``,
    of any type, or as they are found.  The old container stays until the new manifest
    replaces its own, and its data until the write after that, for those who still read it.
    With ``skip_unchanged`` nothing is written if hash and metadata are those of the target.
    ``share`` stores columns of equal content once.  With ``directory`` the tables of objects and
    blocks are written too, which ``broken_guards`` and ``directory_of`` read.  ``row_names`` names
    a column of distinct texts that are the names of a table's rows.  What is not given of
    ``compress``, ``hash`` and ``block`` comes from the session's options (``strataform.options``).
    """
    if mode not in ("auto", "strict"):
        raise ArgumentError("mode is auto or strict")
    native = isinstance(value, DataFrame) or (isinstance(value, dict) and bool(value) and all(isinstance(v, DataFrame) and isinstance(k, str) and k for k, v in value.items()))
    if not native and mode == "strict":
        raise UnsupportedError("only tables and named archives of tables are stored column by column")
    if native:
        tables = {"": value} if isinstance(value, DataFrame) else value
        spark = next(iter(tables.values())).sparkSession
        orders = order if isinstance(order, dict) else {k: order for k in tables}
        held = {k: _ordered(df, row, orders.get(k)) for k, df in tables.items()}
        # A column of the name of the positions holds them and nothing else.
        tables = {k: df.drop(ROW) for k, df in tables.items()}
        for name, df in tables.items():
            _check_names(df, row_names if name in ("", next(iter(tables))) else None)
    elif spark is None:
        raise ArgumentError("an opaque value needs the session")
    hash, block = options.get(spark, "hash", hash), options.get(spark, "block", block)
    if skip_unchanged and not hash:
        raise ArgumentError("skip_unchanged needs the hash")
    metadata, level = check_metadata(metadata), _level(options.get(spark, "compress", compress))
    store = Store(spark, path)
    if skip_unchanged:
        digest = _value_hash(spark, value if not native else None, tables if native else {}, held if native else {}, block)
        if _unchanged(spark, path, digest, metadata):
            return path
    version = f"v-{uuid.uuid4().hex}"
    manifest: dict[str, Any] = {"format": FORMAT, "writer": f"strataform {__version__}", "version": version, "codec": "native" if native else "opaque", "metadata": metadata, "attributes": attributes or {}, "compress": level, "block": block, "row_names": row_names, "objects": []}
    if native:
        hashes = []
        for k, (name, df) in enumerate(tables.items()):
            one = _write_table(spark, f"{path}/{version}", k, df, held[name], level, hash, share, block, directory)
            manifest["objects"].append({"id": k, "name": name, **one})
            hashes.append((name, one["hash"]))
        manifest["archive"] = not isinstance(value, DataFrame)
        manifest["hash"] = _joined_hash(hashes) if hash else None
    else:
        payload = pickle.dumps(value, protocol=4)
        chunks = [(k, payload[a : a + CHUNK], hashlib.sha256(payload[a : a + CHUNK]).hexdigest()) for k, a in enumerate(range(0, max(1, len(payload)), CHUNK))]
        spark.createDataFrame(chunks, "seq bigint, bytes binary, digest string").coalesce(1).write.option("compression", "zstd").parquet(f"{path}/{version}/payload")
        manifest |= {"archive": False, "synopsis": synopsis(value), "payload_bytes": len(payload), "hash": hashlib.sha256(canonical_value(value)).hexdigest() if hash else None}
    manifest["stored_bytes"] = Store(spark, f"{path}/{version}").size()
    try:
        before = manifest_of(spark, path)
    except (FormatError, StorageError, VersionError, CodecError):
        before = {}
    manifest["previous"] = before.get("version")
    store.replace("manifest.json", seal(manifest))
    for old in store.names():
        # What another writer has open is young; what a dead one left gets old.
        if old.startswith("v-") and old not in (version, before.get("version")) and (old == before.get("previous") or store.age(old) > GRACE):
            store.delete(old)
    return path


def _check_names(df: DataFrame, column: str | None) -> None:
    if column is None:
        return
    if column not in df.columns:
        raise ArgumentError(f"there is no column {column!r} of row names")
    odd = df.agg(F.count_if(F.col(f"`{column}`").isNull()).alias("none")).first()["none"]
    if odd or df.groupBy(f"`{column}`").count().where("count > 1").limit(1).count():
        raise ArgumentError("row names are distinct and not missing")


def seal(manifest: dict[str, Any]) -> bytes:
    body = json.dumps(manifest, sort_keys=True)
    return json.dumps({"checksum": hashlib.sha256(body.encode()).hexdigest(), "body": body}).encode()


def _joined_hash(hashes: list[tuple[str, str]]) -> str:
    if len(hashes) == 1 and not hashes[0][0]:
        return hashes[0][1]
    return hashlib.sha256("".join(f"{len(n)}:{n}={h};" for n, h in hashes).encode()).hexdigest()


def _value_hash(spark: SparkSession, value: Any, tables: dict[str, DataFrame], held: dict[str, DataFrame], block: int) -> str:
    if not tables:
        return hashlib.sha256(canonical_value(value)).hexdigest()
    return _joined_hash([(n, _table_hash(df, hashing.block_digests(held[n], df.columns, ROW, block))) for n, df in tables.items()])


def canonical_value(value: Any) -> bytes:
    """Bytes that depend on a value alone: numbers by type and bits, parts with their count, entries of dictionaries by key.

    Values of other types are pickled, as far as that tells them apart.
    """
    kind = type(value).__name__
    if value is None or isinstance(value, bool | int):
        body = repr(value).encode()
    elif isinstance(value, float):
        body = struct.pack(">d", value if value == value else math.nan)
    elif isinstance(value, complex):
        body = canonical_value(value.real) + canonical_value(value.imag)
    elif isinstance(value, str):
        body = value.encode("utf-8", "surrogatepass")
    elif isinstance(value, bytes | bytearray):
        body = bytes(value)
    elif isinstance(value, list | tuple):
        body = b"".join(map(canonical_value, value))
    elif isinstance(value, set | frozenset):
        body = b"".join(sorted(map(canonical_value, value)))
    elif isinstance(value, dict):
        body = b"".join(sorted(canonical_value(k) + canonical_value(v) for k, v in value.items()))
    elif hasattr(value, "dtype") and hasattr(value, "tobytes") and value.dtype.kind != "O":
        body = canonical_value((str(value.dtype), list(value.shape))) + value.tobytes()
    else:
        body = pickle.dumps(value, protocol=4)
    return f"{kind}:{len(body)}:".encode() + body


def _unchanged(spark: SparkSession, path: str, digest: str, metadata: dict[str, str]) -> bool:
    try:
        m = manifest_of(spark, path)
    except Exception:  # a target that can't be read is written
        return False
    return m.get("hash") == digest and m["metadata"] == metadata


def _write_table(spark: SparkSession, base: str, k: int, df: DataFrame, held: DataFrame, level: int, with_hash: bool, share: bool, block: int, directory: bool) -> dict[str, Any]:
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        raise UnsupportedError("a column without a type can't be stored")
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise UnsupportedError("columns of a stored table have distinct names")
    kept, same = list(df.columns), {}
    if share:
        found = hashing.shared(hashing.column_digests(held, df.columns, ROW, block)).collect()
        kinds = {f.name: f.dataType for f in df.schema.fields}
        same = {r["column"]: r["shared_with"] for r in found if r["shared_with"] and kinds[r["column"]] == kinds[r["shared_with"]]}
        kept = [c for c in kept if c not in same]
    path = f"{base}/data/{k}"
    writer = held.select(ROW, *kept).repartitionByRange(ROW).sortWithinPartitions(ROW).write
    writer = writer.option("compression", "zstd" if level else "uncompressed").option("parquet.compression.codec.zstd.level", str(max(1, level)))
    writer.option("parquet.page.write-checksum.enabled", "true").option("parquet.page.row.count.limit", "20000").parquet(path)
    stored = spark.read.parquet(path)
    n = stored.agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("lo"), F.max(ROW).alias("hi")).first()
    if n["n"] and (n["lo"] != 0 or n["hi"] != n["n"] - 1 or _distinct_positions(stored) != n["n"]):
        raise ArgumentError("positions count up from 0 without gaps or repeats")
    digest = None
    whole = stored
    for c, target in same.items():
        whole = whole.withColumn(c, F.col(f"`{target}`"))
    whole = whole.select(ROW, *(F.col(f"`{c}`") for c in df.columns if c != ROW))
    if with_hash:
        blocks = hashing.block_digests(whole, df.columns, ROW, block)
        blocks.withColumn("object_id", F.lit(k).cast("bigint")).coalesce(1).write.parquet(f"{base}/blocks/{k}")
        digest = _table_hash(df, spark.read.parquet(f"{base}/blocks/{k}"))
    out = {"rows": n["n"], "schema": df.schema.json(), "shared": same, "hash": digest, "bytes": Store(spark, path).size()}
    return out | ({"directory": directories.write(whole, ROW, block, same, f"{base}/directory/{k}")} if directory else {})


def _distinct_positions(df: DataFrame) -> int:
    """How many positions there are, from bitmaps of a fixed size."""
    bits = df.groupBy(F.bitmap_bucket_number(ROW).alias("b")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(ROW))).alias("n"))
    return bits.agg(F.sum("n").alias("n")).first()["n"] or 0


def manifest_of(spark: SparkSession, path: str) -> dict[str, Any]:
    """The manifest, after its checksum and version have been checked."""
    raw = Store(spark, path).read("manifest.json")
    try:
        outer = json.loads(raw)
        body = outer["body"]
        if hashlib.sha256(body.encode()).hexdigest() != outer["checksum"]:
            raise FormatError("the manifest does not match its checksum")
        m = json.loads(body)
    except (ValueError, KeyError, TypeError) as e:
        raise FormatError("the manifest can't be read") from e
    if m.get("format") != FORMAT:
        raise VersionError(f"format {m.get('format')} is not known here")
    if m.get("codec") not in ("native", "opaque"):
        raise CodecError(f"codec {m.get('codec')!r} is not known here")
    return m


def _table(spark: SparkSession, path: str, m: dict[str, Any], one: dict[str, Any]) -> DataFrame:
    """The stored table with its positions, its shared columns and its column metadata."""
    schema = T.StructType.fromJson(json.loads(one["schema"]))
    kept = T.StructType([T.StructField(ROW, T.LongType()), *(f for f in schema.fields if f.name not in one["shared"])])
    df = spark.read.schema(kept).option("parquet.page.verify-checksum.enabled", "true").parquet(f"{path}/{m['version']}/data/{one['id']}")
    source = lambda f: F.col(f"`{one['shared'].get(f.name, f.name)}`")
    return df.select(ROW, *(source(f).alias(f.name, metadata=f.metadata) for f in schema.fields))


def _object(m: dict[str, Any], name: str | None) -> dict[str, Any]:
    if m["codec"] != "native":
        raise UnsupportedError("the container holds an opaque value")
    if name is None and not m["archive"]:
        return m["objects"][0]
    found = [o for o in m["objects"] if o["name"] == name]
    if not found:
        raise ArgumentError(f"the container has no table {name!r}")
    return found[0]


def read(spark: SparkSession, path: str, *, select: Sequence[str | int] | None = None, positions: Sequence[int] | None = None, window: tuple[int, int] | None = None, table: str | None = None, keep_row: bool = False, row_names: bool = False) -> DataFrame:
    """A table, or some of its columns and rows.

    With ``row_names`` a column ``__name`` comes first: the stored names of the rows, or else
    "1", "2" and so on, counted over what is read.

    ``window`` is a range of positions, last included; ``positions`` any positions, in any
    order and with repeats, in whose order the result's ``__row`` then counts.  Both reach the
    scan as a range, which skips files, row groups and pages.
    """
    m = manifest_of(spark, path)
    one = _object(m, table)
    df = _table(spark, path, m, one)
    names = [c for c in df.columns if c != ROW]
    wanted = [names[k] for k in rows.resolve(names, select)]
    stored_names = m.get("row_names") if row_names else None
    wanted_names = [F.col(f"`{stored_names}`").cast("string").alias(NAME)] if stored_names else []
    df = df.select(ROW, *wanted_names, *(F.col(f"`{c}`") for c in wanted))
    if window is not None:
        if positions is not None:
            raise ArgumentError("ask for a window or for positions")
        df = rows.window(df, ROW, *window)
        window = (max(0, window[0]), window[1])
    if positions is not None:
        df = rows.take(df, ROW, positions, total=one["rows"]).drop(ROW).withColumnRenamed("place", ROW).select(ROW, *([NAME] if stored_names else []), *(F.col(f"`{c}`") for c in wanted))
    if row_names and not stored_names:
        first = window[0] if window is not None else 0
        df = df.select(ROW, (F.col(ROW) - first + 1).cast("string").alias(NAME), *(F.col(f"`{c}`") for c in wanted))
    return df if keep_row else df.drop(ROW)


def write_vector(values: DataFrame | Sequence[Any], path: str, *, spark: SparkSession | None = None, kind: str | None = None, names: Sequence[str] | str | None = None, **written: Any) -> str:
    """A single vector, as the table of one column that ``read_vector`` gives back.

    ``values`` is a table of one column, and one of its names if ``names`` names it, or a
    sequence of values of the Spark type ``kind`` that the driver holds, with ``names`` of equal number.
    """
    if isinstance(values, DataFrame):
        kept = [c for c in values.columns if c not in (names, written.get("row"))]
        if len(kept) != 1:
            raise ArgumentError("a vector is one column")
        df = values.withColumnRenamed(kept[0], "value")
        df = df.withColumnRenamed(names, "name") if isinstance(names, str) else df
        return write(df, path, mode="strict", attributes={"vector": True}, **written)
    if spark is None or kind is None:
        raise ArgumentError("a sequence needs the session and the type of its values")
    if names is not None and (isinstance(names, str) or len(names) != len(values)):
        raise ArgumentError("there are as many names as values")
    held = [(k, v) if names is None else (k, v, names[k]) for k, v in enumerate(values)]
    df = spark.createDataFrame(held, f"{ROW} bigint, value {kind}" + (", name string" if names is not None else ""))
    return write(df, path, row=ROW, mode="strict", attributes={"vector": True}, **written)


def read_vector(spark: SparkSession, path: str, *, positions: Sequence[int] | None = None, window: tuple[int, int] | None = None, names: bool = False) -> DataFrame:
    """__row and value of a single vector, or some of it, and name with ``names``; other columns are not read."""
    m = manifest_of(spark, path)
    if not m["attributes"].get("vector"):
        raise UnsupportedError("the container holds no single vector")
    return read(spark, path, select=["value", *(["name"] if names else [])], positions=positions, window=window, keep_row=True)


def read_targets(spark: SparkSession, path: str, ids: Sequence[int], table: str | None = None) -> DataFrame:
    """The columns, in one scan, of objects by their ids in the directory, and of all that is below them or that they refer to."""
    held = directory_of(spark, path, table)["objects"]
    known = {r["object_id"]: r["type"] for r in held.select("object_id", "type").collect()}
    unknown = [i for i in ids if i not in known]
    if unknown:
        raise ArgumentError(f"no objects of these ids: {', '.join(map(str, unknown))}")
    found = {r["object_id"] for r in graph.wanted(held, list(ids)).collect()}
    one = _object(manifest_of(spark, path), table)
    names = T.StructType.fromJson(json.loads(one["schema"])).names
    return read(spark, path, select=[names[i - 1] for i in sorted(found) if 1 <= i <= len(names)], table=table, keep_row=True)


def describe(spark: SparkSession, path: str) -> str:
    """Text about a container: what it is, then its parts, one a line."""
    m = manifest_of(spark, path)
    head = info(spark, path).first()
    lines = [f"{head['root_type']} in a {m['codec']} container, format {head['format_version']}, {head['stored_bytes']:,} bytes"]
    lines += [f"  {k}: {v}" for k, v in sorted(m["metadata"].items())]
    for r in schema(spark, path).collect():
        shared = f" = {r['shared_with']}" if r["shared_with"] else ""
        lines.append(f"{'  ' * r['depth']}{r['path'] or '.'}  {r['type']}  [{r['shape'] or ''}]{shared}")
    return "\n".join(lines)


def read_opaque(spark: SparkSession, path: str, *, loads: bool = False) -> Any:
    """The payload of an opaque value as bytes, or unpickled if ``loads``; each chunk is checked, in order."""
    m = manifest_of(spark, path)
    if m["codec"] != "opaque":
        raise UnsupportedError("the container holds tables")
    found = spark.read.parquet(f"{path}/{m['version']}/payload").orderBy("seq").toLocalIterator()
    parts = []
    for k, r in enumerate(found):
        if r["seq"] != k or hashlib.sha256(bytes(r["bytes"])).hexdigest() != r["digest"]:
            raise FormatError(f"chunk {k} of the payload is damaged")
        parts.append(bytes(r["bytes"]))
    payload = b"".join(parts)
    if len(payload) != m["payload_bytes"]:
        raise FormatError("the payload ends early")
    return pickle.loads(payload) if loads else payload


def load(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The tables of an archive, or the named ones; each reads its own files only."""
    m = manifest_of(spark, path)
    if not m["archive"]:
        raise ArgumentError("the container is no archive")
    known = [o["name"] for o in m["objects"]]
    unknown = [n for n in names or [] if n not in known]
    if unknown:
        raise ArgumentError(f"the archive has no tables of these names: {', '.join(map(repr, unknown))}")
    return {n: read(spark, path, table=n) for n in (known if names is None else names)}


def save(path: str, tables: dict[str, DataFrame], **options: Any) -> str:
    """An archive of at least one named table."""
    if not tables or any(not isinstance(n, str) or not n for n in tables):
        raise ArgumentError("an archive has named tables, one at least")
    return write(tables, path, mode="strict", **options)


def info(spark: SparkSession, path: str) -> DataFrame:
    """One row about the container, from the manifest alone."""
    m = manifest_of(spark, path)
    native = m["codec"] == "native"
    fields = [(m["format"], m["codec"], m["block"], len(m["objects"]), m["stored_bytes"], "list" if m["archive"] else "data.frame" if native else "opaque", len(m["objects"]) if m["archive"] else m["objects"][0]["rows"] if native else None, sorted(m["attributes"]), m["writer"], m["hash"], m["metadata"], None if native else json.dumps(m["synopsis"]), native)]
    return spark.createDataFrame(fields, "format_version bigint, codec string, block_size bigint, object_count bigint, stored_bytes bigint, root_type string, root_length bigint, attribute_names array<string>, writer string, content_hash string, metadata map<string,string>, synopsis string, authoritative boolean")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """The object graph of a container: its tables, columns and their fields."""
    m = manifest_of(spark, path)
    found: list[tuple] = []

    def add(parent: int | None, ordinal: int, name: str | None, kind: str, length: int | None, columns: int | None, size: int, attributes: Sequence[str]) -> int:
        found.append((len(found), parent, ordinal, name, kind, length, columns, size, None, ", ".join(attributes)))
        return len(found) - 1

    def fields(parent: int, schema: T.StructType, length: int, shared: dict[str, str]) -> None:
        own: dict[str, int] = {}
        for k, f in enumerate(schema.fields, 1):
            nested = isinstance(f.dataType, T.StructType)
            i = own[f.name] = add(parent, k, f.name, "data.frame" if nested else f.dataType.simpleString(), length, len(f.dataType.fields) if nested else None, 0, sorted(f.metadata.get("attributes", {})))
            if nested:
                fields(i, f.dataType, length, {})
        for c, target in shared.items():
            found[own[c]] = (*found[own[c]][:8], own[target], found[own[c]][9])

    root = add(None, 1, None, "list", len(m["objects"]), None, 0, sorted(m["attributes"])) if m["archive"] else None
    for k, o in enumerate(m["objects"], 1):
        schema = T.StructType.fromJson(json.loads(o["schema"]))
        fields(add(root, k, o["name"] or None, "data.frame", o["rows"], len(schema.fields), o["bytes"], [] if m["archive"] else sorted(m["attributes"])), schema, o["rows"], o["shared"])
    if m["codec"] == "opaque":
        add(None, 1, None, "opaque", None, None, m["payload_bytes"], [])
    return spark.createDataFrame(found, "object_id bigint, parent_id bigint, ordinal bigint, name string, type string, logical_len bigint, columns bigint, stored_bytes bigint, shared_with bigint, attributes string")


def schema(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """id, path, depth, type, length, columns, shape, attributes, stored_bytes (of all below) and shared_with, depth first."""
    own = graph.tree(objects(spark, path))
    if not recursive:
        own = own.where("depth <= 1")
    size = graph.subtree_bytes(objects(spark, path)).withColumnRenamed("stored_bytes", "total")
    paths = own.select(F.col("object_id").alias("shared_with"), F.col("path").alias("target"))
    out = own.join(size, "object_id").join(paths, "shared_with", "left")
    shape = F.when(F.col("columns").isNotNull(), F.concat_ws(" x ", "logical_len", "columns")).otherwise(F.col("logical_len").cast("string"))
    return out.select(F.col("object_id").alias("id"), "path", "depth", "type", F.col("logical_len").alias("length"), "columns", shape.alias("shape"), "attributes", F.col("total").alias("stored_bytes"), F.col("target").alias("shared_with"), "sort_key").orderBy("sort_key").drop("sort_key")


def attributes(spark: SparkSession, path: str, where: Sequence[str | int] = (), names: Sequence[str] | None = None) -> dict[str, Any]:
    """Attributes of the value, or of the part at a path of names and 1-based places."""
    m = manifest_of(spark, path)
    steps = list(where)
    if not steps:
        found = dict(m["attributes"])
        if m["codec"] == "native" and not m["archive"]:
            found = {"names": T.StructType.fromJson(json.loads(m["objects"][0]["schema"])).names, "class": "data.frame", **found}
    else:
        if m["archive"]:
            step = steps.pop(0)
            known = [o["name"] for o in m["objects"]]
            one = _object(m, step if isinstance(step, str) else known[step - 1] if 1 <= step <= len(known) else None)
        else:
            one = m["objects"][0]
        kind: T.DataType = T.StructType.fromJson(json.loads(one["schema"]))
        found = {"names": kind.names, "class": "data.frame"}
        for k, step in enumerate(steps, 1):
            if not isinstance(kind, T.StructType):
                raise ArgumentError(f"step {k} of the path leads into a column")
            place = rows.resolve(kind.names, [step])[0]
            f = kind.fields[place]
            kind, found = f.dataType, dict(f.metadata.get("attributes", {}))
            if isinstance(kind, T.StructType):
                found = {"names": kind.names, "class": "data.frame", **found}
    if names is None:
        return found
    unknown = sorted({n for n in names if n not in found})
    if unknown:
        raise ArgumentError(f"no attributes of these names: {', '.join(map(repr, unknown))}")
    return {n: found[n] for n in names}


def verify(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """object_id and blk of the blocks whose rows do not give the digest that was stored; none if all is well.

    Each page is checked on the way.  With ``content`` the hash of the whole is compared too
    and a difference raises an error.
    """
    m = manifest_of(spark, path)
    if m["codec"] == "opaque":
        read_opaque(spark, path)
        return spark.createDataFrame([], "object_id bigint, blk bigint")
    out = None
    for o in m["objects"]:
        if o["hash"] is None:
            raise UnsupportedError("the container was written without hashes")
        df = _table(spark, path, m, o)
        names = [c for c in df.columns if c != ROW]
        now = hashing.block_digests(df, names, ROW, m["block"])
        then = spark.read.parquet(f"{path}/{m['version']}/blocks/{o['id']}")
        bad = now.join(then.select("blk", F.col("digest").alias("was"), F.col("n").alias("m")), "blk", "full").where(~(F.col("digest").eqNullSafe(F.col("was")) & F.col("n").eqNullSafe(F.col("m"))))
        bad = bad.select(F.lit(o["id"]).cast("bigint").alias("object_id"), "blk")
        out = bad if out is None else out.unionByName(bad)
        if content and _table_hash(df.drop(ROW), now) != o["hash"]:
            raise FormatError(f"table {o['name']!r} does not have the content that was stored")
    return out


def directory_of(spark: SparkSession, path: str, table: str | None = None) -> dict[str, DataFrame]:
    """manifest, objects, attributes, blocks and codes of a table that was written with its directory."""
    m = manifest_of(spark, path)
    one = _object(m, table)
    if "directory" not in one:
        raise UnsupportedError("the container was written without a directory")
    outer = json.loads(Store(spark, path).read("manifest.json"))
    return directories.load(spark, f"{path}/{m['version']}/directory/{one['id']}", _table(spark, path, m, one), ROW, m["block"], outer, m, one)


def broken_guards(spark: SparkSession, path: str, table: str | None = None) -> list[str]:
    """Names of the integrity guards that a table's directory breaks; none if all is well."""
    return guards.check(spark, directory_of(spark, path, table))


def synopsis(value: Any) -> dict[str, Any]:
    """A bounded description of an opaque value."""

    def cut(text: str) -> str:
        return text.encode()[:SYNOPSIS_BYTES].decode("utf-8", "ignore")

    kind = [cut(c.__name__) for c in type(value).__mro__[:32]]
    names = [cut(str(n)) for n in list(value)[:SYNOPSIS_NAMES]] if isinstance(value, dict) else []
    size = len(value) if hasattr(value, "__len__") else None
    shape = [int(x) for x in value.shape[:32]] if hasattr(value, "shape") else None
    return {"class": kind, "length": size, "dim": shape, "names": names, "truncated": isinstance(value, dict) and len(value) > SYNOPSIS_NAMES}


def serialize(value: DataFrame | Any, *, metadata: dict[str, str] | None = None, most: int = 256 << 20) -> bytes:
    """A value as bytes: tables as Arrow, others pickled; for values that fit the driver, up to ``most`` bytes."""
    head = {"format": FORMAT, "metadata": check_metadata(metadata)}
    if isinstance(value, DataFrame):
        import pyarrow as pa

        # A lower bound of the bytes is added up first, so that a table over the limit is not collected.
        size = value.select(F.sum(sum((F.octet_length(F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit(""))) if isinstance(f.dataType, T.StringType | T.BinaryType) else F.lit(4) for f in value.schema.fields), F.lit(0))).alias("n")).first()["n"] or 0
        if size > most:
            raise LimitError("the value is too large to be held as bytes")
        out = pa.BufferOutputStream()
        data = value.toArrow()
        with pa.ipc.new_stream(out, data.schema) as w:
            w.write_table(data)
        body, head["codec"], head["schema"] = out.getvalue().to_pybytes(), "native", value.schema.json()
    else:
        body, head["codec"] = pickle.dumps(value, protocol=4), "opaque"
    if len(body) > most:
        raise LimitError("the value is too large to be held as bytes")
    head["checksum"] = hashlib.sha256(body).hexdigest()
    return b"STRF" + base64.b64encode(json.dumps(head).encode()) + b"\n" + body


def unserialize(spark: SparkSession, data: bytes, *, select: Sequence[str | int] | None = None, positions: Sequence[int] | None = None, loads: bool = False) -> Any:
    """The value of ``serialize``; columns and positions can be asked for if it is a table.

    Other values come as the bytes of a pickle, or unpickled if ``loads``, for trusted bytes only.
    """
    if data[:4] != b"STRF" or b"\n" not in data:
        raise FormatError("these are not the bytes of a value")
    head, body = json.loads(base64.b64decode(data[4 : data.index(b"\n")])), data[data.index(b"\n") + 1 :]
    if hashlib.sha256(body).hexdigest() != head["checksum"]:
        raise FormatError("the bytes do not match their checksum")
    if head["codec"] == "opaque":
        return pickle.loads(body) if loads else body
    import pyarrow as pa

    found = pa.ipc.open_stream(body).read_all()
    if positions is not None:
        if any(not 0 <= p < found.num_rows for p in positions):
            raise ArgumentError("positions are whole numbers inside the table")
        found = found.take(pa.array(positions, pa.int64()))
    schema_ = T.StructType.fromJson(json.loads(head["schema"]))
    keep = rows.resolve(schema_.names, select)
    return spark.createDataFrame(found.select(keep), T.StructType([schema_.fields[k] for k in keep]))


def block_count(rows_: int, block: int = BLOCK) -> int:
    return -(-rows_ // block)


__all__ = ["attributes", "block_count", "broken_guards", "check_metadata", "describe", "directory_of", "div", "info", "load", "manifest_of", "objects", "read", "read_opaque", "read_targets", "read_vector", "save", "schema", "serialize", "synopsis", "table_hash", "unserialize", "verify", "write", "write_vector"]
