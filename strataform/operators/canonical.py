"""Records that decode but could not have been written: each check returns the rows that break it.

Inputs are encoded forms as tables; every check is one filter or one window inside a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_PERIOD = 64
MOST_WIDTH = 32
MOST_EXPONENT = 18
MOST_TAG = 4


def two_bit(states: DataFrame) -> DataFrame:
    """Slots (of byte, slot, state) with the state that is reserved."""
    return states.where((F.col("state") == 3) | F.col("state").isNull())


def constant(records: DataFrame) -> DataFrame:
    """Records (blk, n, state, reserved) of no rows, of an unknown state, or with reserved bits."""
    return records.where((F.col("n") < 1) | ~F.col("state").between(0, 2) | (F.col("reserved") != 0))


def dense(words: DataFrame, width: int = 32) -> DataFrame:
    """Words (blk, n, word, true_word, na_word) whose planes meet, or that have bits past the block's end."""
    left = F.least(F.col("n") - F.col("word") * width, F.lit(width)).cast("int")
    past = F.call_function("shiftright", F.col("true_word").bitwiseOR(F.col("na_word")), F.greatest(left, F.lit(0)))
    return words.where((F.col("true_word").bitwiseAND(F.col("na_word")) != 0) | (past != 0) | (left <= 0))


def sparse(exceptions: DataFrame) -> DataFrame:
    """Exceptions (blk, n, default_state, seq, pos, state) of the default state, out of the block, or not after the one before."""
    before = F.lag("pos").over(Window.partitionBy("blk").orderBy("seq"))
    bad = (F.col("state") == F.col("default_state")) | (F.col("pos") >= F.col("n")) | F.coalesce(F.col("pos") <= before, F.lit(False))
    return _flagged(exceptions, bad)


def runs(found: DataFrame) -> DataFrame:
    """Runs (blk, n, run, value, end) that do not end after the one before, have its value, or do not end with the block."""
    order = Window.partitionBy("blk").orderBy("run")
    first = F.row_number().over(order) == 1
    last = F.lead("end").over(order).isNull()
    rises = F.col("end") > F.coalesce(F.lag("end").over(order), F.lit(0))
    same = ~first & F.lag("value").over(order).eqNullSafe(F.col("value"))
    return _flagged(found, ~rises | same | (last & (F.col("end") != F.col("n"))))


def periodic(records: DataFrame) -> DataFrame:
    """Records (blk, n, period) with a period out of 2 to 64, or of less than four periods."""
    return records.where(~F.col("period").between(2, MOST_PERIOD) | (F.col("n") < 4 * F.col("period")))


def framed(records: DataFrame) -> DataFrame:
    """Frames and deltas (blk, n, width, missing, least, bits_after) that are too wide, flag missing values without codes, reach the missing value, or have bits after the last code."""
    return records.where(~F.col("width").between(0, MOST_WIDTH) | (F.col("missing") & (F.col("width") == 0)) | (F.col("least") <= -(1 << 31)) | (F.col("bits_after") != 0))


def decimal(records: DataFrame) -> DataFrame:
    """Vectors (vec, n, e, f, width, delta) with a factor above the exponent, an exponent above 18, a width above 64, or steps of one value."""
    return records.where((F.col("f") > F.col("e")) | ~F.col("e").between(0, MOST_EXPONENT) | ~F.col("width").between(0, 64) | (F.col("delta") & (F.col("n") < 2)))


def string_records(records: DataFrame) -> DataFrame:
    """Records (row, tag, length) of an unknown tag, or missing (tag 0) with a length."""
    return records.where(~F.col("tag").between(0, MOST_TAG) | ((F.col("tag") == 0) & (F.col("length") != 0)))


def block_sizes(blocks: DataFrame) -> DataFrame:
    """Blocks (object_id, logical_len, logical_count) without values in an object that has some."""
    return blocks.where((F.col("logical_count") < 1) & (F.col("logical_len") > 0))


def flags(entries: DataFrame, required: int, size: int, most: int = 256) -> DataFrame:
    """Entries (id, flags, bytes) with a required flag that is not known, or of a size out of ``size`` to ``most``."""
    unknown = F.col("flags").bitwiseAND(F.lit(0xFF00)).bitwiseAND(F.bitwise_not(F.lit(required)))
    return entries.where((unknown != 0) | ~F.col("bytes").between(size, most))


def _flagged(df: DataFrame, bad: Column) -> DataFrame:
    """The rows for which ``bad``, which may hold windows, is true."""
    return df.withColumn("_bad", bad).where("_bad").drop("_bad")
