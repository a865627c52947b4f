"""Three-valued logical blocks: counts, bit planes, exceptions, periods and the choice of encoding.

Inputs have blk, pos, row and v (boolean, null for missing).  States are 0 for false, 1 for
true, 2 for missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import div
from . import runs

LONGEST_PERIOD = 64


def state() -> Column:
    return F.when(F.col("v").isNull(), 2).when(F.col("v"), 1).otherwise(0)


def default_state() -> Column:
    """The state with the largest count; ties go to false, then true."""
    most = F.greatest("n_false", "n_true", "n_na")
    return F.when(F.col("n_false") == most, 0).when(F.col("n_true") == most, 1).otherwise(2)


def stats(df: DataFrame) -> DataFrame:
    """blk, n, n_false, n_true, n_na, runs and default_state."""
    marked = df.withColumn("_s", state()).withColumn("_change", runs.changes("v"))
    count = lambda s: F.sum((F.col("_s") == s).cast("bigint"))
    found = marked.groupBy("blk").agg(F.count(F.lit(1)).alias("n"), count(0).alias("n_false"), count(1).alias("n_true"), count(2).alias("n_na"), F.sum("_change").cast("bigint").alias("runs"))
    return found.withColumn("default_state", default_state())


def planes(df: DataFrame, width: int = 32) -> DataFrame:
    """blk, word and the words of the true and the missing plane, lowest bit first."""
    bit = F.expr(f"shiftleft(1L, cast(pos % {width} as int))")
    zero = F.lit(0).cast("bigint")
    return df.groupBy("blk", div("pos", width).alias("word")).agg(F.sum(F.when(F.col("v"), bit).otherwise(zero)).alias("true_word"), F.sum(F.when(F.col("v").isNull(), bit).otherwise(zero)).alias("na_word"))


def unplaned(planes_: DataFrame, width: int = 32) -> DataFrame:
    """blk, pos and v from the words; positions past the end of a block come out false."""
    bits = planes_.select("blk", "word", "true_word", "na_word", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    has = lambda c: F.expr(f"(shiftright({c}, k) & 1) = 1")
    return bits.select("blk", (F.col("word") * width + F.col("k")).alias("pos"), F.when(~has("na_word"), has("true_word")).alias("v"))


def exceptions(df: DataFrame) -> DataFrame:
    """blk, pos and state of the rows that are not of their block's default state."""
    whole = Window.partitionBy("blk")
    count = lambda s: F.sum((F.col("state") == s).cast("bigint")).over(whole)
    held = df.withColumn("state", state()).withColumns({"n_false": count(0), "n_true": count(1), "n_na": count(2)})
    return held.where(F.col("state") != default_state()).select("blk", "pos", "state")


def periods(df: DataFrame) -> DataFrame:
    """blk and the shortest period of 2 to 64 (at most a quarter of the block) of blocks with many runs.

    A block is two arrays of 32-bit words, one of trues and one of missing values; a candidate
    shifts them and compares whole words, up to the first that differs.
    """
    words = F.array_sort(F.collect_list(F.struct("word", "true_word", "na_word")))
    held = planes(df).groupBy("blk").agg(words.alias("w"))
    held = held.select("blk", F.transform("w", lambda x: x["true_word"]).alias("t"), F.transform("w", lambda x: x["na_word"]).alias("m"))
    held = held.join(stats(df).where(2 * F.col("runs") > F.col("n")).select("blk", "n"), "blk")
    ones = F.lit((1 << 32) - 1)

    def fits(p: Column) -> Column:
        """Whether all values equal those ``p`` places on."""
        skip, bits = div(p, 32).cast("int"), (p % 32).cast("int")

        def moved(plane: str, k: Column) -> Column:
            low = F.coalesce(F.get(plane, k + skip), F.lit(0).cast("bigint"))
            high = F.coalesce(F.get(plane, k + skip + 1), F.lit(0).cast("bigint"))
            return F.call_function("shiftright", low, bits).bitwiseOR(F.call_function("shiftleft", high, F.lit(32) - bits)).bitwiseAND(ones)

        def same(k: Column) -> Column:
            left = F.col("n") - p - 32 * k
            mask = F.when(left >= 32, ones).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), left.cast("int")) - 1)
            differ = moved("t", k).bitwiseXOR(F.get("t", k)).bitwiseOR(moved("m", k).bitwiseXOR(F.get("m", k)))
            return differ.bitwiseAND(mask) == 0

        return F.forall(F.sequence(F.lit(0), div(F.col("n") - p - 1, 32).cast("int")), same)

    longest = F.least(F.lit(LONGEST_PERIOD), div("n", 4)).cast("int")
    first = F.get(F.filter(F.sequence(F.lit(2), longest), fits), 0)
    return held.where("n >= 8").select("blk", first.cast("bigint").alias("period")).where("period is not null")


def choose(df: DataFrame) -> DataFrame:
    """blk with the bytes of each encoding and the chosen one."""
    s = stats(df).join(periods(df), "blk", "left")
    most = F.greatest("n_false", "n_true", "n_na")
    states = sum(((F.col(c) > 0).cast("bigint") for c in ("n_false", "n_true", "n_na")), F.lit(0))
    s = s.withColumn("dense_bytes", 4 + (states - 1) * div(F.col("n") + 7, 8)).withColumn("sparse_bytes", 16 + 2 * (F.col("n") - most)).withColumn("run_bytes", 8 + 8 * F.col("runs"))
    s = s.withColumn("period_bytes", 4 + 4 + div(F.col("period") + 3, 4))
    others = F.least("dense_bytes", "sparse_bytes", "run_bytes")
    name = (
        F.when(most == F.col("n"), "constant")
        .when(F.col("period_bytes") < others, "periodic")
        .when((F.col("run_bytes") < F.col("dense_bytes")) & (F.col("run_bytes") <= F.col("sparse_bytes")), "runs")
        .when(F.col("sparse_bytes") < F.col("dense_bytes"), "sparse")
        .otherwise("dense")
    )
    return s.select("blk", "n", "dense_bytes", "sparse_bytes", "run_bytes", "period_bytes", name.alias("encoding"))


def two_bit(df: DataFrame, column: str = "byte") -> DataFrame:
    """``df`` with the four states of a byte, lowest bits first."""
    return df.select("*", F.posexplode(F.array(*(F.shiftright(column, 2 * k).bitwiseAND(F.lit(3)) for k in range(4)))).alias("slot", "state"))
