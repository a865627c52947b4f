"""Directory tables of a container: its objects, their attributes, their blocks, and facts of each block's record.

They are written beside the data and hold what the integrity guards need.  A block's record is
the smallest encoding of its values, by the rules of ``strataform.operators``; the bytes on
disk are Parquet's.
"""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import doubles, guards, hashing, integers, logical, rows, runs, strings

#: Where the first record starts.
HEAD = 32
#: Places that decimals of a double column are looked for at.
PLACES = 2
FACTS = "width bigint, last_end bigint, ends_rise bigint, record_bytes bigint, top_id bigint, entries bigint, top_position bigint"


def kind_of(kind: T.DataType) -> str:
    """The kind of object that a column is stored as."""
    if isinstance(kind, T.BooleanType):
        return "logical"
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType):
        return "integer"
    if isinstance(kind, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        return "double"
    return "character"


def _value(name: str, kind: T.DataType) -> Any:
    c = F.col(f"`{name}`")
    if kind_of(kind) == "double" and not isinstance(kind, T.NumericType):
        return (F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(c.cast("timestamp"))).cast("double")
    if kind_of(kind) == "character" and not isinstance(kind, T.StringType):
        return hashing.canonical(c, kind)
    return c.cast({"logical": "boolean", "integer": "int", "double": "double", "character": "string"}[kind_of(kind)])


def records(df: DataFrame, kind: str, block: int) -> DataFrame:
    """blk, part, logical_count, decoded_len, encoding and the facts of the records of one column (row, v)."""
    df = rows.with_block(df, "row", block)
    if kind == "logical":
        found = logical.choose(df)
        ends = runs.runs(df, "v").groupBy("blk").agg(F.max("end").alias("e"), (F.min("len") > 0).cast("bigint").alias("r"))
        is_runs = F.col("encoding") == "runs"
        size = F.when(F.col("encoding") == "constant", 4).when(F.col("encoding") == "periodic", F.col("period_bytes")).when(is_runs, F.col("run_bytes")).when(F.col("encoding") == "sparse", F.col("sparse_bytes")).otherwise(F.col("dense_bytes"))
        found = found.join(ends, "blk")
        return _facts(found, size, F.concat(F.lit("logical_"), "encoding"), last_end=F.when(is_runs, F.col("e")), ends_rise=F.when(is_runs, F.col("r")))
    if kind == "integer":
        widths = integers.delta(integers.frame(integers.stats(df))).select("blk", "for_width", "delta_width", "runs")
        found = integers.choose(df).join(widths, "blk")
        is_runs = F.col("encoding") == "runs"
        width = F.when(F.col("encoding") == "delta", F.col("delta_width")).when(F.col("encoding") == "frame", F.col("for_width"))
        return _facts(found, F.col("bytes"), F.when(is_runs, "int_runs").otherwise(F.col("encoding")), width=width, last_end=F.when(is_runs, F.col("n")), ends_rise=F.when(is_runs & (F.col("runs") <= F.col("n")), 1))
    if kind == "double":
        odd = df.where(~doubles.is_decimal("v", PLACES)).groupBy("blk").agg(F.max(F.col("row") % doubles.VECTOR).alias("top"))
        found = doubles.choose(df, PLACES, block).join(odd, "blk", "left")
        is_decimal = F.col("encoding") == "decimal"
        size = F.when(is_decimal, F.col("decimal_bytes")).when(F.col("encoding") == "runs", F.col("run_bytes")).otherwise(F.col("raw_bytes"))
        return _facts(found, size, F.when(F.col("encoding") == "runs", "double_runs").otherwise(F.col("encoding")), ends_rise=F.when(is_decimal, 1), top_position=F.when(is_decimal, F.col("top")))
    if strings.policy(df).first()["policy"] == "plain":
        found = strings.record_bytes(df)
        return _facts(found, F.col("bytes"), F.lit("records"), record_bytes=F.col("bytes"))
    entries = strings.dictionary(df)
    held = entries.agg(F.count(F.lit(1)).alias("n"), F.sum(5 + F.coalesce(F.octet_length("v"), F.lit(0))).alias("bytes")).withColumn("blk", F.lit(0).cast("bigint"))
    coded = strings.encode(df, entries).groupBy(strings.div("row", block).alias("blk")).agg(F.max("id").alias("top"))
    found = strings.chunks(df, block).withColumnRenamed("chunk", "blk").join(coded, "blk").crossJoin(F.broadcast(held.select(F.col("n").alias("all"))))
    index = _facts(found, F.col("index_bytes"), F.lit("index"), top_id=F.col("top"), entries=F.col("all"))
    return index.unionByName(_facts(held, F.col("bytes"), F.lit("entries"), part=0))


def _facts(df: DataFrame, size: Any, encoding: Any, part: int = 1, **facts: Any) -> DataFrame:
    own = [facts.get(c.split()[0], F.lit(None)).cast("bigint").alias(c.split()[0]) for c in FACTS.split(", ")]
    return df.select("blk", F.lit(part).alias("part"), F.col("n").alias("logical_count"), size.cast("bigint").alias("decoded_len"), encoding.alias("encoding"), *own)


def sums(df: DataFrame, columns: list[str], row: str, block: int) -> DataFrame:
    """column, blk and digest of the values of each block of each column, in one scan."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.sha2(hashing.canonical(F.col(f"`{c}`"), kinds[c]), 256).alias("h")) for c in columns))).alias("c")
    long = df.select(F.col(row).cast("bigint").alias("row"), cells).select("row", "c.column", "c.h", strings.div("row", block).alias("blk"))
    return long.groupBy("column", "blk").agg(hashing.ordered_digest("h", "row").alias("digest"))


def build(df: DataFrame, row: str, block: int, shared: dict[str, str]) -> dict[str, DataFrame]:
    """objects, attributes, blocks and codes of one table; ``shared`` names the column that holds another's values.

    The root is object 0, its columns follow, then the values of its attributes.
    """
    spark = df.sparkSession
    schema = [f for f in df.schema.fields if f.name != row]
    number = {f.name: k for k, f in enumerate(schema, 1)}
    # Of equal columns the first one holds the values, whichever the table names.
    groups: dict[str, list[str]] = {}
    for f in schema:
        groups.setdefault(shared.get(f.name, f.name), []).append(f.name)
    holder = {c: own[0] for own in groups.values() for c in own}
    own = [f for f in schema if holder[f.name] == f.name]
    found = None
    for f in own:
        one = records(df.select(F.col(row).cast("bigint").alias("row"), _value(f.name, f.dataType).alias("v")), kind_of(f.dataType), block)
        one = one.withColumns({"object_id": F.lit(number[f.name]).cast("bigint"), "column": F.lit(f.name)})
        found = one if found is None else found.unionByName(one)
    digests = sums(df, [f.name for f in own], row, block)
    found = found.join(digests, ["column", "blk"], "left")
    order = Window.orderBy("object_id", "blk", "part")
    found = found.withColumn("sequence", (F.row_number().over(order) - 1).cast("bigint"))
    start = F.coalesce(F.sum("decoded_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + HEAD
    found = found.withColumn("start_at", start.cast("bigint"))
    blocks = found.select("sequence", "object_id", "blk", "part", "start_at", F.col("decoded_len").alias("stored_len"), "logical_count", "decoded_len", F.lit(0).cast("bigint").alias("compression"), "encoding", F.when(F.col("part") == 1, F.col("digest")).alias("checksum"))
    codes = found.select("sequence", "encoding", "width", "last_end", "ends_rise", "record_bytes", "top_id", "entries", F.lit(None).cast("bigint").alias("frame_len"), "top_position")
    n, last = df.count(), len(schema)
    listed = [(0, None, "data.frame", n, last, 0, None)]
    listed += [(number[f.name], 0, kind_of(f.dataType), n, 0, 1, number[holder[f.name]] if holder[f.name] != f.name else None) for f in schema]
    listed += [(last + 1, None, "character", last, 0, 1, None), (last + 2, None, "character", 1, 0, 1, None)]
    spans = blocks.groupBy("object_id").agg(F.min("sequence").alias("first_block"), F.count(F.lit(1)).alias("block_count"))
    objects = spark.createDataFrame(listed, "object_id bigint, parent_id bigint, type string, logical_len bigint, child_count bigint, depth bigint, shared_with bigint").join(spans, "object_id", "left").fillna(0, ["first_block", "block_count"])
    attributes = spark.createDataFrame([(0, "names", last + 1), (0, "class", last + 2)], guards.SCHEMAS["attributes"])
    return {"objects": objects.select(*_names("objects")), "attributes": attributes, "blocks": blocks, "codes": codes}


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in guards.SCHEMAS[table].split(", ")]


def write(df: DataFrame, row: str, block: int, shared: dict[str, str], base: str) -> dict[str, Any]:
    """Writes the tables in the folder ``base`` and returns what the manifest keeps of them."""
    for name, one in build(df, row, block, shared).items():
        one.coalesce(1).write.parquet(f"{base}/{name}")
    held = _read(df.sparkSession, base)
    sizes = held["blocks"].agg(F.count(F.lit(1)).alias("n"), F.max("decoded_len").alias("most")).first()
    return {"digest": digest(held), "n_objects": held["objects"].count(), "n_blocks": sizes["n"], "block_bytes": sizes["most"] or 0}


def _read(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{base}/{t}") for t in ("objects", "attributes", "blocks", "codes")}


def digest(tables: dict[str, DataFrame]) -> str:
    """Over all rows of the tables, in their order."""
    parts = []
    for name, key in (("objects", "object_id"), ("attributes", "value_object"), ("blocks", "sequence"), ("codes", "sequence")):
        root = hashing.root_digest(hashing.block_digests(tables[name], sorted(tables[name].columns), key, 65_536)).first()
        parts.append(root["digest"] if root else "")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def load(spark: SparkSession, base: str, data: DataFrame, row: str, block: int, outer: dict[str, str], manifest: dict[str, Any], one: dict[str, Any]) -> dict[str, DataFrame]:
    """The tables that the guards look at: what is stored, and the sums that data and directory give now."""
    held = _read(spark, base)
    numbers = {f.name: k for k, f in enumerate((f for f in data.schema.fields if f.name != row), 1)}
    names = spark.createDataFrame([(c, k) for c, k in numbers.items()], "column string, object_id bigint")
    now = sums(data, list(numbers), row, block).join(F.broadcast(names), "column").select("object_id", "blk", F.col("digest").alias("now"))
    blocks = held["blocks"].join(now, ["object_id", "blk"], "left").withColumn("checksum_found", F.when(F.col("part") == 1, F.col("now")))
    metadata = sum(len(k.encode()) + len(v.encode()) for k, v in manifest["metadata"].items())
    kept = one["directory"]
    top = (kept["n_objects"], kept["n_blocks"], kept["block_bytes"], metadata, outer["checksum"], hashlib.sha256(outer["body"].encode()).hexdigest(), kept["digest"], digest(held))
    return {
        "manifest": spark.createDataFrame([top], guards.SCHEMAS["manifest"]),
        "objects": held["objects"],
        "attributes": held["attributes"],
        "blocks": blocks.select(*_names("blocks")),
        "codes": held["codes"],
    }

