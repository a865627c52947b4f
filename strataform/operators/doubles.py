"""Double blocks: runs on bits, decimal detection, decimal vectors and the choice.

Inputs have blk, row and v (double, null for missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import as_column, bit_length, bits_key, div, packed_bytes
from . import runs

VECTOR = 1024


def scaled(v: str | Column, e: int, f: int = 0) -> Column:
    """The whole number nearest to v * 10**e / 10**f; null where that leaves the exact range."""
    x = as_column(v) * float(10**e) / float(10**f)
    return F.when(F.abs(x) < 9.0e15, F.floor(x + 0.5).cast("bigint"))


def unscaled(n: str | Column, e: int, f: int = 0) -> Column:
    return as_column(n).cast("double") * float(10**f) / float(10**e)


def is_decimal(v: str | Column, e: int, f: int = 0) -> Column:
    """Whether v is exactly a whole number times 10**f over 10**e, bits and all."""
    v = as_column(v)
    back = unscaled(scaled(v, e, f), e, f)
    return F.coalesce((back == v) & (bits_key(back) == bits_key(v)), F.lit(False))


def equals_decimal(v: str | Column, e: int) -> Column:
    """Whether v, of any size, compares equal to a whole number over 10**e, as SQL has it; null for null.

    Unlike ``is_decimal`` this looks at numbers and not at bits or codes: -0.0 is 0, and NaN and
    the infinities equal themselves.
    """
    v = as_column(v)
    x = v * float(10**e) + 0.5
    # From 2**52 on doubles are whole, and the floor of larger ones would not fit a bigint.
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x) / float(10**e) == v


def decimal_places(v: str | Column, most: int = 4) -> Column:
    """The fewest decimal places that hold v exactly; null where more than ``most`` are needed."""
    return F.coalesce(*(F.when(is_decimal(v, e), e) for e in range(most + 1))).cast("bigint")


def bit_runs(df: DataFrame) -> DataFrame:
    return runs.runs(df, "v", key=bits_key("v"))


def vectors(df: DataFrame, e: int, f: int = 0) -> DataFrame:
    """Decimal vectors of 1,024 rows: vec, n, exceptions, for_width, delta_width, codes and bytes.

    An exception takes the number before it in its vector, so that it costs no width.
    """
    v = df.withColumn("vec", div("row", VECTOR)).withColumn("_n", F.when(is_decimal("v", e, f), scaled("v", e, f)))
    upto = Window.partitionBy("vec").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("vec").orderBy(F.col("row").desc()).rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("_f", F.coalesce(F.last("_n", ignorenulls=True).over(upto), F.last("_n", ignorenulls=True).over(back), F.lit(0)))
    v = v.withColumn("_d", F.col("_f") - F.lag("_f").over(Window.partitionBy("vec").orderBy("row")))
    s = v.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_n").isNull().cast("bigint")).alias("exceptions"), F.min("_f").alias("lo"), F.max("_f").alias("hi"), F.min("_d").alias("dlo"), F.max("_d").alias("dhi"))
    s = s.withColumn("for_width", bit_length(F.col("hi") - F.col("lo"))).withColumn("delta_width", F.when(F.col("n") >= 2, bit_length(F.col("dhi") - F.col("dlo"))))
    use_delta = F.coalesce(F.col("delta_width") + 1 < F.col("for_width"), F.lit(False))
    s = s.withColumn("delta", use_delta)
    size = F.when(F.col("delta"), 24 + packed_bytes(F.col("n") - 1, "delta_width")).otherwise(16 + packed_bytes("n", "for_width"))
    return s.select("vec", "n", "exceptions", "for_width", "delta_width", "delta", (size + 10 * F.col("exceptions")).alias("bytes"))


def searched(df: DataFrame) -> DataFrame:
    """What ``vectors`` gives, for the best of the candidate pairs in each vector, with e and f."""
    found = None
    for k, (e, f) in enumerate((r["e"], r["f"]) for r in candidates(df).collect()):
        one = vectors(df, e, f).withColumns({"e": F.lit(e).cast("bigint"), "f": F.lit(f).cast("bigint"), "_k": F.lit(k)})
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors(df, 0).withColumns({"e": F.lit(0).cast("bigint"), "f": F.lit(0).cast("bigint")})
    names = [c for c in found.columns if c not in ("vec", "_k")]
    best = found.groupBy("vec").agg(F.min(F.struct("bytes", "_k", *(c for c in names if c != "bytes"))).alias("b"))
    return best.select("vec", *(F.col(f"b.{c}").alias(c) for c in names))


def byte_planes(df: DataFrame) -> DataFrame:
    """row and the eight bytes of the bits of v, lowest first."""
    bits = df.select("row", F.expr("cast(reflect('java.lang.Double', 'doubleToRawLongBits', v) as bigint)").alias("bits"))
    return bits.select("row", *(F.shiftrightunsigned("bits", 8 * k).bitwiseAND(F.lit(255)).cast("bigint").alias(f"b{k}") for k in range(8)))


def joined_planes(planes: DataFrame) -> DataFrame:
    """row and v from the eight bytes."""
    bits = F.lit(0).cast("bigint")
    for k in range(8):
        bits = bits.bitwiseOR(F.shiftleft(F.col(f"b{k}").cast("bigint"), 8 * k))
    return planes.select("row", bits.alias("bits")).selectExpr("row", "cast(reflect('java.lang.Double', 'longBitsToDouble', bits) as double) AS v")


def choose(df: DataFrame, e: int | None, block: int) -> DataFrame:
    """blk with the bytes of raw values, runs and decimals, and the smallest (decimals only if strictly so).

    Without ``e`` the pair of exponent and factor is searched for, vector by vector.
    """
    n = df.groupBy("blk").agg(F.count(F.lit(1)).alias("n"))
    r = runs.run_count(df, bits_key("v"))
    decimals = (searched(df) if e is None else vectors(df, e)).groupBy(div(F.col("vec") * VECTOR, block).alias("blk")).agg(F.sum("bytes").alias("decimal_bytes"))
    # Blocks that whole vectors do not fill hold no decimals.
    s = n.join(r, "blk").join(decimals.where(F.lit(block % VECTOR == 0)), "blk", "left")
    s = s.withColumn("raw_bytes", 8 * F.col("n")).withColumn("run_bytes", 8 + 16 * F.col("runs"))
    other = F.least("raw_bytes", "run_bytes")
    name = F.when((F.col("n") >= 64) & (F.col("decimal_bytes") < other) & (8 * F.col("decimal_bytes") < 48 * F.col("n")), "decimal").when(F.col("run_bytes") < F.col("raw_bytes"), "runs").otherwise("raw")
    return s.select("blk", "n", "raw_bytes", "run_bytes", "decimal_bytes", name.alias("encoding"))


def candidates(df: DataFrame, most: int = 18, keep: int = 5, sampled: int = 256) -> DataFrame:
    """Pairs (e, f) of an exponent and a factor, by how many sampled values they hold exactly.

    ``sampled`` is the bound of the sample, taken evenly over the rows by position; the pair
    table has 190 rows.  Only the choice of candidates rests on it, no value does.
    """
    total = df.agg(F.max("row").alias("m")).first()["m"]
    if total is None:
        return df.sparkSession.createDataFrame([], "e bigint, f bigint, hits bigint")
    step = max(1, (total + 1) // sampled)
    some = df.where((F.col("row") % step == 0) & F.col("v").isNotNull()).select("v").limit(2 * sampled)
    pairs = df.sparkSession.range(most + 1).select(F.col("id").alias("e")).select("e", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("e"))).alias("f"))
    n = F.floor(F.col("v") * F.pow(F.lit(10.0), "e") / F.pow(F.lit(10.0), "f") + 0.5).cast("double")
    back = n * F.pow(F.lit(10.0), "f") / F.pow(F.lit(10.0), "e")
    both = some.join(F.broadcast(pairs), F.abs(F.col("v") * F.pow(F.lit(10.0), F.col("e") - F.col("f"))) < 9.0e15)
    hits = both.groupBy("e", "f").agg(F.sum((back == F.col("v")).cast("bigint")).alias("hits"))
    return hits.orderBy(F.desc("hits"), "e", F.desc("f")).limit(keep)
