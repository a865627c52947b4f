"""Column expressions that the operators share; all run inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: str | Column, b: int | Column) -> Column:
    """Whole-number quotient of values that are not negative."""
    a = as_column(a)
    return ((a - a % b) / b).cast("bigint")


def bit_length(value: str | Column) -> Column:
    """Binary digits of a whole number that is not negative; 0 has none."""
    value = as_column(value)
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(value))).cast("bigint")


def packed_bytes(count: str | Column, width: str | Column) -> Column:
    """Bytes of ``count`` codes of ``width`` bits each."""
    return div(as_column(count) * as_column(width) + 7, 8)


def bits_key(value: str | Column) -> Column:
    """Text that is equal for doubles with equal bits only: it tells -0.0 from 0.0, and all NaNs are one."""
    return as_column(value).cast("string")


def byte_plane(value: str | Column, k: int) -> Column:
    """Byte ``k`` of a 32-bit integer, lowest first."""
    return F.shiftright(as_column(value).cast("int"), 8 * k).bitwiseAND(F.lit(255)).cast("bigint")


def utf8_prefix(value: str | Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes."""
    value = as_column(value)
    lengths = F.transform(F.sequence(F.lit(0), F.least(F.length(value), F.lit(most))), lambda k: F.struct(F.octet_length(F.substring(value, F.lit(1), k)).alias("b"), k.alias("k")))
    fits = F.filter(lengths, lambda x: x["b"] <= most)
    return F.substring(value, F.lit(1), F.element_at(fits, -1)["k"])
