"""Content hashes that depend on values and their order alone.

A row's digest covers all its columns, a block's the digests of its rows in order, and the
root's those of the blocks.  Each level is an ordered concatenation inside one group, so
neither partitioning nor encoding shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import div


def canonical(c: Column, kind: T.DataType) -> Column:
    """Text that stands for one value and no other of its type.

    A missing value is ``~``, strings have their length before them, and nested values the
    number of their parts; times count microseconds.  Keys of maps come in the order of their text.
    """
    if isinstance(kind, T.StringType | T.CharType | T.VarcharType):
        text = F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, T.DoubleType | T.FloatType):
        text = c.cast("double").cast("string")
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.StructType):
        parts = [canonical(c.getField(f.name), f.dataType) for f in kind.fields]
        text = F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws("|", *parts), F.lit("}")))
    elif isinstance(kind, T.ArrayType):
        parts = F.array_join(F.transform(c, lambda x: canonical(x, kind.elementType)), ",")
        text = F.concat(F.lit("["), F.size(c).cast("string"), F.lit(":"), parts, F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda x: F.concat(canonical(x["key"], kind.keyType), F.lit("="), canonical(x["value"], kind.valueType)))
        text = F.concat(F.lit("<"), F.size(c).cast("string"), F.lit(":"), F.array_join(F.array_sort(pairs), ","), F.lit(">"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("~"))


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.sha2(F.concat_ws("|", *(canonical(F.col(f"`{c}`"), kinds[c]) for c in columns)), 256)


def ordered_digest(digests: str, order: str) -> Column:
    """Digest of the digests of a group in the order of ``order``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(digests).alias("d"))))
    return F.sha2(F.array_join(F.transform(pairs, lambda p: p["d"]), ""), 256)


def block_digests(df: DataFrame, columns: list[str], row: str, size: int) -> DataFrame:
    """blk, n and digest; a block has ``size`` rows, so a group is bounded."""
    rows = df.select(F.col(row).cast("bigint").alias("row"), div(F.col(row).cast("bigint"), size).alias("blk"), row_digest(df, columns).alias("h"))
    return rows.groupBy("blk").agg(F.count(F.lit(1)).alias("n"), ordered_digest("h", "row").alias("digest"))


def root_digest(blocks: DataFrame, fan: int = 4096, keys: tuple[str, ...] = ()) -> DataFrame:
    """digest and n, of the whole or for each value of ``keys``, joined in levels of ``fan`` blocks so that no group grows with the table."""
    level = blocks.select(*keys, "blk", "digest", "n")
    while True:
        level = level.groupBy(*keys, div("blk", fan).alias("up")).agg(F.sum("n").cast("bigint").alias("n"), ordered_digest("digest", "blk").alias("digest")).withColumnRenamed("up", "blk")
        top = level.agg(F.max("blk").alias("m")).first()["m"]
        if not top:
            return level.select(*keys, "digest", "n")


def string_digests(df: DataFrame) -> DataFrame:
    """row and digest of each value.  A digest costs less than the shuffle that would share it."""
    return df.select("row", F.sha2("v", 256).alias("digest"))


def column_digests(df: DataFrame, columns: list[str], row: str, size: int) -> DataFrame:
    """column and digest, one scan for all columns, joined in levels."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.sha2(canonical(F.col(f"`{c}`"), kinds[c]), 256).alias("h")) for c in columns))).alias("c")
    long = df.select(F.col(row).cast("bigint").alias("row"), cells).select("row", "c.column", "c.h", div("row", size).alias("blk"))
    blocks = long.groupBy("column", "blk").agg(F.count(F.lit(1)).alias("n"), ordered_digest("h", "row").alias("digest"))
    return root_digest(blocks, keys=("column",)).drop("n")


def shared(digests: DataFrame) -> DataFrame:
    """column and shared_with: the first column, by name, with the same content; null for that one itself."""
    firsts = digests.groupBy("digest").agg(F.min("column").alias("first"))
    return digests.join(firsts, "digest").select("column", F.when(F.col("column") != F.col("first"), F.col("first")).alias("shared_with"))
