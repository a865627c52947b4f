"""Runs of equal values inside blocks: gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_column


def changes(key: str | Column, block: str = "blk", row: str = "row") -> Column:
    """1 where a run starts.  Missing values equal each other; the first row of a block starts a run."""
    order = Window.partitionBy(block).orderBy(row)
    key = as_column(key)
    return F.when(F.row_number().over(order) == 1, 1).when(F.lag(key).over(order).eqNullSafe(key), 0).otherwise(1)


def runs(df: DataFrame, value: str, *, key: str | Column | None = None, block: str = "blk", row: str = "row") -> DataFrame:
    """blk, run, value, first (row), len and end (position after the run in its block)."""
    key = as_column(value if key is None else key)
    marked = df.withColumn("_change", changes(key, block, row))
    upto = Window.partitionBy(block).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("run", F.sum("_change").over(upto).cast("bigint"))
    found = marked.groupBy(block, "run").agg(F.first(value).alias("value"), F.min(row).alias("first"), F.count(F.lit(1)).alias("len"))
    ends = Window.partitionBy(block).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("end", F.sum("len").over(ends))


def run_count(df: DataFrame, key: str | Column, *, block: str = "blk", row: str = "row") -> DataFrame:
    return df.withColumn("_change", changes(key, block, row)).groupBy(block).agg(F.sum("_change").cast("bigint").alias("runs"))
