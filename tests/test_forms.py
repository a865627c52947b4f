"""Bit streams, canonical forms, directories, vectors, row names and options."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform import options
from strataform.errors import ArgumentError, FormatError, UnsupportedError
from strataform.operators import canonical, doubles, logical, packing, rows, runs
from strataform.sources import container

B = 512


@pytest.mark.parametrize("width", [0, 1, 5, 8, 13, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 100])
def test_bit_streams_invert(width, n):
    r = np.random.default_rng(width * 101 + n)
    codes = r.integers(0, 1 << width, n) if width else np.zeros(n, np.int64)
    data = packing.bits_to_bytes(codes, width)
    assert len(data) == (n * width + 7) // 8
    assert int.from_bytes(data, "little") == sum(int(c) << (width * k) for k, c in enumerate(codes))
    assert packing.bytes_to_codes(data, n, width).tolist() == codes.tolist()


def test_bit_streams_refuse_what_was_not_written():
    for data, n, width in ((b"\x08", 3, 1), (b"", 1, 1), (b"\0\0", 1, 1), (b"\0" * 9, 1, 33)):
        with pytest.raises(FormatError):
            packing.bytes_to_codes(data, n, width)


@pytest.fixture
def flags(spark):
    r = random.Random(4)
    values = [r.choice([True, False, False, None]) for _ in range(1300)] + [True] * 300
    df = spark.createDataFrame(list(enumerate(values)), "row bigint, v boolean")
    return rows.with_block(df, "row", B)


def test_forms_that_were_written_pass(flags):
    n = flags.groupBy("blk").agg(F.count(F.lit(1)).alias("n"))
    assert canonical.dense(logical.planes(flags).join(n, "blk")).count() == 0
    assert canonical.runs(runs.runs(flags, "v").join(n, "blk")).count() == 0
    held = logical.exceptions(flags).join(logical.stats(flags).select("blk", "n", "default_state"), "blk").withColumn("seq", F.col("pos"))
    assert held.count() > 100
    assert canonical.sparse(held).count() == 0
    doubled = held.unionByName(held.limit(1).withColumn("seq", F.col("seq") + 0.5))
    assert canonical.sparse(doubled).count() == 1


def test_periods_equal_brute_force(spark):
    r = random.Random(9)
    for p in (2, 31, 32, 33, 64, 65):
        unit = [r.choice([True, False, None]) for _ in range(p)]
        unit[:3] = [True, False, None][: min(3, p)]
        for n in (4 * p, 299) if p != 64 else (4 * p - 1, 4 * p):
            values = [unit[k % p] for k in range(n)]
            df = rows.with_block(spark.createDataFrame(list(enumerate(values)), "row bigint, v boolean").coalesce(1), "row", 4096)
            own = [q for q in range(2, 65) if n >= 4 * q and all(values[k] == values[k + q] for k in range(n - q))]
            many = 2 * (1 + sum(a != b for a, b in zip(values, values[1:], strict=False))) > n
            assert [x["period"] for x in logical.periods(df).collect()] == (own[:1] if many else []), (p, n)


def test_decimals_are_searched_and_invert(spark):
    r = random.Random(6)
    values = [r.randrange(10**6) / 1000 for _ in range(2000)] + [r.random() for _ in range(48)]
    df = rows.with_block(spark.createDataFrame(list(enumerate(values)), "row bigint, v double"), "row", 1024)
    found = doubles.searched(df).orderBy("vec").collect()
    assert [x["n"] for x in found] == [1024, 1024]
    assert found[0]["exceptions"] == 0
    assert found[1]["exceptions"] <= 48 + 5
    best = doubles.choose(df, None, 1024).orderBy("blk").collect()
    fixed = doubles.choose(df, 2, 1024).orderBy("blk").collect()
    assert all(a["decimal_bytes"] <= b["decimal_bytes"] for a, b in zip(best, fixed, strict=True))
    assert best[0]["encoding"] == "decimal"
    e, f = found[0]["e"], found[0]["f"]
    back = df.where("blk = 0").select("v", doubles.unscaled(doubles.scaled("v", e, f), e, f).alias("b"))
    assert back.where("v <> b").count() == 0


def test_double_planes_invert(spark):
    values = [0.0, -0.0, 1.5, -2.25e-300, float("inf"), 5e-324, float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "row bigint, v double")
    back = [x["v"] for x in doubles.joined_planes(doubles.byte_planes(df)).orderBy("row").collect()]
    assert [np.float64(x).tobytes() for x in back] == [np.float64(x).tobytes() for x in values]


def test_directories_see_damage(spark, tmp_path):
    df = spark.range(1500).select(F.col("id").alias("row"), (F.col("id") % 7).cast("int").alias("k"), (F.col("id") % 2 == 0).alias("b"), (F.col("id") / 4).alias("x"), F.concat(F.lit("t"), F.col("id") % 3).alias("s"), (F.col("id") % 7).cast("int").alias("again"))
    path = container.write(df, str(tmp_path / "c"), row="row", block=B, share=True, directory=True)
    assert container.broken_guards(spark, path) == []
    held = container.directory_of(spark, path)
    assert held["blocks"].agg(F.sum("logical_count").alias("n")).first()["n"] == 5 * 1500 + 3
    m = container.manifest_of(spark, path)
    where = f"{path}/{m['version']}/directory/0/codes"
    codes = spark.read.parquet(where).withColumn("last_end", F.col("last_end") + 1).withColumn("top_id", F.col("entries")).collect()
    schema = spark.read.parquet(where).schema
    spark.createDataFrame(codes, schema).write.mode("overwrite").parquet(where)
    broken = container.broken_guards(spark, path)
    assert {"directory_checksum", "dict_index_range"} <= set(broken)
    plain = container.write(df, str(tmp_path / "p"), row="row")
    with pytest.raises(UnsupportedError):
        container.directory_of(spark, plain)


def test_vectors_names_and_text(spark, tmp_path):
    path = container.write_vector([3.5, None, 1.0], str(tmp_path / "v"), spark=spark, kind="double", names=["a", "b", "c"])
    assert [tuple(r) for r in container.read_vector(spark, path, names=True).orderBy("__row").collect()] == [(0, 3.5, "a"), (1, None, "b"), (2, 1.0, "c")]
    assert [r["value"] for r in container.read_vector(spark, path, positions=[2, 2]).orderBy("__row").collect()] == [1.0, 1.0]
    df = spark.createDataFrame([(0, "x", 1), (1, "y", 2)], "row bigint, label string, n int")
    table = container.write(df, str(tmp_path / "t"), row="row", row_names="label", metadata={"unit": "m"})
    assert [r["__name"] for r in container.read(spark, table, select=["n"], positions=[1, 0], row_names=True, keep_row=True).orderBy("__row").collect()] == ["y", "x"]
    assert [r["__name"] for r in container.read(spark, container.write(df, str(tmp_path / "u"), row="row"), positions=[1, 1], row_names=True, keep_row=True).orderBy("__row").collect()] == ["1", "2"]
    text = container.describe(spark, table)
    assert "unit: m" in text
    assert "$label  string  [2]" in text
    with pytest.raises(UnsupportedError):
        container.read_vector(spark, table)
    for names in ("n2", "twice"):
        with pytest.raises(ArgumentError):
            container.write(df.withColumn("twice", F.lit("z")), str(tmp_path / "w"), row="row", row_names=names)


def test_options_of_the_session(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "row").withColumn("v", F.lit(1))
    with options.using(spark, block=128, hash=False):
        m = container.manifest_of(spark, container.write(df, str(tmp_path / "a"), row="row"))
        assert (m["block"], m["hash"]) == (128, None)
        assert container.manifest_of(spark, container.write(df, str(tmp_path / "b"), row="row", block=64))["block"] == 64
    assert container.manifest_of(spark, container.write(df, str(tmp_path / "c"), row="row"))["block"] == 65_536
    with pytest.raises(ArgumentError), options.using(spark, speed=1):
        pass
