"""Integer blocks: statistics, sizes of each encoding, the choice, and the inverse steps.

Inputs have blk, row and v (int or bigint, null for missing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bit_length, byte_plane, div, packed_bytes
from . import runs


def stats(df: DataFrame) -> DataFrame:
    """blk, n, n_na, min_v, max_v, runs and the least and largest step between neighbours."""
    order = Window.partitionBy("blk").orderBy("row")
    marked = df.withColumn("_change", runs.changes("v")).withColumn("_step", F.col("v").cast("bigint") - F.lag("v").over(order))
    return marked.groupBy("blk").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("v").isNull().cast("bigint")).alias("n_na"),
        F.min("v").cast("bigint").alias("min_v"),
        F.max("v").cast("bigint").alias("max_v"),
        F.sum("_change").cast("bigint").alias("runs"),
        F.min("_step").alias("min_step"),
        F.max("_step").alias("max_step"),
    )


def frame(stats_: DataFrame) -> DataFrame:
    """Adds for_width and for_bytes: codes from the minimum, with one more code if values are missing."""
    spread = F.coalesce(F.col("max_v") - F.col("min_v"), F.lit(0)) + (F.col("n_na") > 0).cast("bigint")
    return stats_.withColumn("for_width", bit_length(spread)).withColumn("for_bytes", 8 + packed_bytes("n", "for_width"))


def delta(stats_: DataFrame) -> DataFrame:
    """Adds delta_width and delta_bytes; null where steps can't be stored."""
    width = F.when((F.col("n_na") == 0) & (F.col("n") >= 2), bit_length(F.col("max_step") - F.col("min_step")))
    out = stats_.withColumn("delta_width", width)
    return out.withColumn("delta_bytes", F.when(F.col("delta_width") <= 32, 16 + packed_bytes(F.col("n") - 1, "delta_width")))


def widened(stats_: DataFrame) -> DataFrame:
    """Adds stored_bits without compression: codes of up to 16 bits widen to 8 or 16 where that beats raw values."""
    wide = F.when(F.col("for_width").between(1, 8), 8).when(F.col("for_width").between(9, 16), 16)
    fits = 8 + packed_bytes("n", wide) < 4 * F.col("n")
    return stats_.withColumn("stored_bits", F.when(wide.isNotNull() & fits, wide).otherwise(F.col("for_width")).cast("bigint"))


def choose(df: DataFrame) -> DataFrame:
    """blk with the bytes of each encoding and the smallest; ties go to runs, delta, frame, raw."""
    s = delta(frame(stats(df)))
    s = s.withColumn("run_bytes", 8 + 8 * F.col("runs")).withColumn("raw_bytes", 4 * F.col("n"))
    usable = F.when(F.col("delta_width") < F.col("for_width"), F.col("delta_bytes"))
    s = s.withColumn("delta_bytes", usable)
    least = F.least("run_bytes", "delta_bytes", "for_bytes", "raw_bytes")
    name = F.when(F.col("run_bytes") == least, "runs").when(F.col("delta_bytes") == least, "delta").when(F.col("for_bytes") == least, "frame").otherwise("raw")
    return s.select("blk", "n", "n_na", "run_bytes", "delta_bytes", "for_bytes", "raw_bytes", least.alias("bytes"), name.alias("encoding"))


def codes(df: DataFrame) -> DataFrame:
    """row and code: the value less the minimum of its block, all ones for a missing one."""
    whole = Window.partitionBy("blk")
    held = df.withColumns({"min_v": F.min("v").over(whole).cast("bigint"), "max_v": F.max("v").over(whole).cast("bigint"), "n": F.count(F.lit(1)).over(whole), "n_na": F.sum(F.col("v").isNull().cast("bigint")).over(whole)})
    ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("for_width").cast("int")) - 1
    return frame(held).select("blk", "row", F.when(F.col("v").isNull(), ones).otherwise(F.col("v") - F.col("min_v")).cast("bigint").alias("code"))


def steps(df: DataFrame) -> DataFrame:
    """blk, row, first (of the block) and step (null on the first row)."""
    order = Window.partitionBy("blk").orderBy("row")
    return df.select("blk", "row", F.first("v").over(order).cast("bigint").alias("first"), (F.col("v").cast("bigint") - F.lag("v").over(order)).alias("step"))


def restored(steps_: DataFrame) -> DataFrame:
    """blk, row and v from the first value and the steps."""
    upto = Window.partitionBy("blk").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return steps_.select("blk", "row", (F.col("first") + F.sum(F.coalesce("step", F.lit(0))).over(upto)).alias("v"))


def planes(df: DataFrame) -> DataFrame:
    """row and the four bytes of v."""
    return df.select("blk", "row", *(byte_plane("v", k).alias(f"b{k}") for k in range(4)))


def joined_planes(planes_: DataFrame) -> DataFrame:
    v = F.col("b0") + F.shiftleft("b1", 8) + F.shiftleft("b2", 16) + F.shiftleft("b3", 24)
    return planes_.select("blk", "row", F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v).alias("v"))


def plain_wins(df: DataFrame, sample: int = 4096) -> DataFrame:
    """blk, sampled, distinct_v and plain: whether at most half of evenly spread values are distinct."""
    sized = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("blk")))
    step = F.greatest(div("_n", sample), F.lit(1))
    spread = sized.where(F.col("pos") % step == 0)
    found = spread.groupBy("blk").agg(F.count(F.lit(1)).alias("sampled"), F.countDistinct("v").alias("distinct_v"))
    return found.withColumn("plain", 2 * F.col("distinct_v") < F.col("sampled"))
