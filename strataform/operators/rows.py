"""Row positions: blocks, windows, positional takes and projections."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions.exprs import div
from ..sources.storage import stored

#: A take with more positions than this is joined by a shuffle, not broadcast.
MOST_BROADCAST = 1_000_000


def with_block(df: DataFrame, row: str, size: int) -> DataFrame:
    """``df`` with blk (row div size) and pos (row mod size)."""
    return df.withColumn("blk", div(row, size)).withColumn("pos", F.col(row) % size)


def resolve(columns: Sequence[str], select: Sequence[str | int] | None) -> list[int]:
    """0-based places of the selected columns, given by name or 1-based position; order counts, repeats don't.

    The first of equal names is meant.  All unknown names are reported together.
    """
    if select is None:
        return list(range(len(columns)))
    if any(x is None for x in select):
        raise ArgumentError("a selection can't contain a missing value")
    if all(isinstance(x, str) for x in select):
        first: dict[str, int] = {}
        for k, c in enumerate(columns):
            first.setdefault(c, k)
        unknown = [x for x in select if x not in first]
        if unknown:
            raise ArgumentError(f"no columns of these names: {', '.join(map(repr, unknown))}")
        found = [first[x] for x in select]
    elif all(isinstance(x, int | float) and not isinstance(x, bool) and float(x).is_integer() for x in select):
        found = [int(x) - 1 for x in select]
        if any(not 0 <= k < len(columns) for k in found):
            raise ArgumentError(f"positions are from 1 to {len(columns)}")
    else:
        raise ArgumentError("columns are selected by names or by whole positions")
    if len(set(found)) < len(found):
        raise ArgumentError("a column can be selected once only")
    return found


def select(df: DataFrame, wanted: Sequence[str | int] | None) -> DataFrame:
    """The wanted columns, in the order in which they are asked for."""
    return df.select(*(F.col(f"`{df.columns[k]}`") for k in resolve(df.columns, wanted)))


def window(df: DataFrame, row: str, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last``; the range reaches the Parquet scan."""
    return df.where(F.col(row).between(first, last))


def take(df: DataFrame, row: str, positions: Sequence[int], *, total: int | None = None) -> DataFrame:
    """Rows by 0-based position in any order, with repeats; ``place`` is where each was asked for."""
    if any(p != int(p) or p < 0 or total is not None and p >= total for p in positions):
        raise ArgumentError("positions are whole numbers inside the table")
    spark = df.sparkSession
    asked = spark.createDataFrame([(k, int(p)) for k, p in enumerate(positions)], "place bigint, asked bigint")
    if not positions:
        return asked.join(df, asked["asked"] == df[row]).drop("asked")
    near = window(df, row, min(positions), max(positions))
    asked = F.broadcast(asked) if len(positions) <= MOST_BROADCAST else asked
    return near.join(asked, near[row] == asked["asked"]).drop("asked")


def number(df: DataFrame, order: Sequence[str], name: str = "row", buckets: int | None = None) -> DataFrame:
    """0-based positions in the order of ``order``, columns of any type that can be sorted, nulls first.

    Rows are dealt into ranges of all columns together, so that a frequent first value is
    spread, sorted there and written once; what is ordered over the whole is one count a
    range.  Ties are broken by where a row was found.  Without columns, rows are numbered as
    they are found, partition by partition.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    found, at, part = (f"__{x}_{uuid.uuid4().hex[:8]}" for x in ("found", "at", "part"))
    dealt = df
    if order:
        keys = [F.col(f"`{c}`") for c in order]
        dealt = df.withColumn(found, F.monotonically_increasing_id()).repartitionByRange(buckets, *keys, found).sortWithinPartitions(*keys, found).drop(found)
    # The upper bits of the number tell the partition, the lower 33 the place in it.
    held = stored(dealt.withColumn(at, F.monotonically_increasing_id()), "numbered")
    held = held.withColumn(part, F.shiftright(at, 33))
    counts = held.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return held.join(F.broadcast(counts.withColumnRenamed("_base", found)), part).withColumn(name, (F.col(found) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop(part, at, found)
