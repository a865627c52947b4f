"""String blocks: dictionaries by first occurrence, distinct estimates, policies, records and factors.

Inputs have row and v (string, null for missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import FormatError
from ..functions.exprs import as_column, div

THRESHOLD = 0.75
MOST_ENTRIES = 1 << 22
CHUNK = 65_536
#: Values that a distinct share is estimated from; fewer are counted exactly.
SAMPLE = 16_384


def dictionary(df: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """id, v and first_row of each value, ids by first occurrence from 0; values past ``most`` ids have no entry.

    Values are reduced before they are shuffled.  They are numbered inside chunks of rows,
    and what is ordered over the whole is one count a chunk.
    """
    firsts = df.groupBy("v").agg(F.min("row").alias("first_row")).withColumn("_chunk", div("first_row", CHUNK))
    counts = firsts.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")).where(F.col("_base") < most)
    inside = F.row_number().over(Window.partitionBy("_chunk").orderBy("first_row")) - 1
    found = firsts.withColumn("_inside", inside).join(counts, "_chunk")
    return found.select((F.col("_base") + F.col("_inside")).cast("bigint").alias("id"), "v", "first_row").where(F.col("id") < most)


def encode(df: DataFrame, entries: DataFrame) -> DataFrame:
    """row and id; values without an entry keep a null id."""
    e = entries.select(F.col("v").alias("_v"), "id")
    return df.join(e, df["v"].eqNullSafe(e["_v"]), "left").select("row", "id")


def decode(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """row and v; an id without an entry is an error."""
    found = ids.join(entries.select("id", "v", F.lit(True).alias("_known")), "id", "left")
    check = F.when(F.col("_known"), F.lit(0)).otherwise(F.raise_error(F.lit("an index has no dictionary entry")).cast("int"))
    return found.withColumn("_ok", check).where("_ok = 0").select("row", "v")


def chunks(df: DataFrame, size: int) -> DataFrame:
    """chunk, n, new_entries, base and width (bytes) of the index blocks of a dictionary over all rows."""
    entries = dictionary(df)
    coded = encode(df, entries).withColumn("chunk", div("row", size))
    new = entries.groupBy(div("first_row", size).alias("chunk")).agg(F.count(F.lit(1)).alias("new_entries"))
    s = coded.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("base"), F.max("id").alias("top")).join(new, "chunk", "left")
    width = F.when(F.col("top") - F.col("base") < 1 << 8, 1).when(F.col("top") - F.col("base") < 1 << 16, 2).otherwise(4)
    return s.select("chunk", "n", F.coalesce("new_entries", F.lit(0)).cast("bigint").alias("new_entries"), "base", width.cast("bigint").alias("width"), (8 + F.col("n") * width).alias("index_bytes"))


def block_dictionary(df: DataFrame, size: int) -> DataFrame:
    """Entries of a dictionary that starts anew in each chunk: chunk, v and the place of its entry."""
    firsts = df.withColumn("chunk", div("row", size)).groupBy("chunk", "v").agg(F.min("row").alias("first_row"))
    return firsts.select("chunk", "v", (F.row_number().over(Window.partitionBy("chunk").orderBy("first_row")) - 1).cast("bigint").alias("entry"))


def sampled_positions(n: int, count: int = SAMPLE) -> list[int]:
    """The fixed sample of positions, with repeats: a xorshift generator, its high product modulo ``n``."""
    state, mask, out = 0x9E3779B97F4A7C15, (1 << 64) - 1, []
    for _ in range(count):
        state ^= state >> 12
        state ^= state << 25 & mask
        state ^= state >> 27
        out.append((state * 0x2545F4914F6CDD1D & mask) % n)
    return out


def distinct_share(df: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """n, d, f1, f2 and share of the values of ``df`` (row, v), rows counting from 0.

    Up to ``sample`` values the share of distinct ones is exact.  Of more, a fixed sample of
    positions gives d distinct values, f1 of them once and f2 twice, and the bias-corrected
    Chao1 estimate d + f1 (f1 - 1) / (2 (f2 + 1)) over n, at most 1.
    """
    n = df.count()
    if n <= sample:
        counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    else:
        times: dict[int, int] = {}
        for p in sampled_positions(n, sample):
            times[p] = times.get(p, 0) + 1
        asked = df.sparkSession.createDataFrame(list(times.items()), "row bigint, c bigint")
        counts = df.join(F.broadcast(asked), "row").groupBy("v").agg(F.sum("c").alias("c"))
    s = counts.agg(F.lit(n).cast("bigint").alias("n"), F.count(F.lit(1)).alias("d"), F.count(F.when(F.col("c") == 1, 1)).alias("f1"), F.count(F.when(F.col("c") == 2, 1)).alias("f2"))
    estimate = F.col("d") if n <= sample else F.col("d") + F.col("f1") * (F.col("f1") - 1) / (2 * (F.col("f2") + 1))
    return s.withColumn("share", F.lit(0.0) if not n else F.least(F.lit(1.0), estimate / F.col("n")))


def policy(df: DataFrame) -> DataFrame:
    """n, share and the policy: a dictionary if less than three quarters of the values are distinct."""
    s = distinct_share(df).select("n", "share")
    return s.withColumn("policy", F.when(F.col("share") < THRESHOLD, "global").otherwise("plain"))


def record_bytes(df: DataFrame, block: str = "blk") -> DataFrame:
    """Bytes of plain records a block: five, and those of the text."""
    return df.groupBy(block).agg(F.count(F.lit(1)).alias("n"), F.sum(5 + F.coalesce(F.octet_length("v"), F.lit(0))).cast("bigint").alias("bytes"))


def packed(df: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """row and piece of records packed in order, a piece closing before the record that would pass ``limit``.

    Packing is sequential inside one chunk (65,536 rows), which is what a task holds.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("row")
        out, piece, used = [], 0, 0
        for size in pdf["bytes"]:
            if used and used + size > limit:
                piece, used = piece + 1, 0
            used += size
            out.append(piece)
        return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "piece": out})

    sized = df.select("row", div("row", CHUNK).alias("chunk"), (5 + F.coalesce(F.octet_length("v"), F.lit(0))).cast("bigint").alias("bytes"))
    return sized.groupBy("chunk").applyInPandas(run, "row bigint, chunk bigint, piece bigint")


def tag(raw: str | Column) -> Column:
    """How bytes are to be read: "na", "native" (ASCII), "utf8", or "bytes" where they are no UTF-8."""
    raw = as_column(raw)
    text = raw.cast("string")
    ascii_ = F.length(text) == F.octet_length(raw)
    return F.when(raw.isNull(), "na").when(~F.is_valid_utf8(text), "bytes").when(ascii_, "native").otherwise("utf8")


def converted(raw: str | Column, encoding: str | Column) -> Column:
    """Text of bytes in the encoding "native", "utf8" or "latin1"; null where they are no text of it."""
    raw, encoding = as_column(raw), as_column(encoding)
    valid = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    ascii_ = F.when(F.length(valid) == F.octet_length(raw), valid)
    return F.when(encoding == "latin1", F.decode(raw, "ISO-8859-1")).when(encoding == "utf8", valid).when(encoding == "native", ascii_)


def levels(df: DataFrame, ordered: list[str] | None = None) -> DataFrame:
    """code (from 1) and level: the given order, or the distinct values in theirs."""
    spark = df.sparkSession
    if ordered is not None:
        if len(set(ordered)) != len(ordered):
            raise FormatError("levels are distinct")
        return spark.createDataFrame(list(enumerate(ordered, 1)), "code bigint, level string")
    found = df.where("v is not null").select("v").distinct()
    return found.select(F.row_number().over(Window.orderBy("v")).cast("bigint").alias("code"), F.col("v").alias("level"))


def to_codes(df: DataFrame, levels_: DataFrame) -> DataFrame:
    return df.join(levels_, df["v"] == levels_["level"], "left").select("row", "code")


def from_codes(codes: DataFrame, levels_: DataFrame) -> DataFrame:
    return codes.join(levels_, "code", "left").select("row", F.col("level").alias("v"))


def bad_codes(codes: DataFrame, count: int) -> DataFrame:
    """Rows whose code is neither missing nor one of 1 to ``count``."""
    return codes.where(F.col("code").isNotNull() & ~F.col("code").between(1, count))
