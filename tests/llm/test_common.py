from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.llm import blooms, common, words


def one_each(batches):
    """The sum of a partition, as one row."""
    import pyarrow as pa

    total = sum(int(x) for b in batches for x in b.column(0).to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([str(total).encode()], pa.binary())], ["x"])


@pytest.mark.parametrize(("n", "bound"), [(1, 8), (5, common.AT_ONCE), (80, 1 << 20)])
def test_tree_merge_adds_all_partitions(spark, n, bound):
    df = spark.range(0, 1000, 1, n).select(F.col("id").cast("string").cast("binary").alias("x"))
    add = lambda a, b: str(int(a) + int(b)).encode()
    values = df.mapInArrow(one_each, "x binary")
    assert int(common.tree_merge(values, "x", add, bound)) == sum(range(1000))
    assert common.tree_merge(values.limit(0), "x", add, bound) is None


def test_the_shared_folder_is_the_session_s(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = common.stored(spark.range(5), "x")
    assert df.count() == 5
    assert common.shared_dir(spark) in df.inputFiles()[0].replace("file:///", "file:///")


@pytest.mark.parametrize("parts", [1, 7])
def test_filter_has_all_that_repeats(spark, parts):
    df = spark.range(0, 400, 1, parts).select((F.col("id") % 350).alias("h"))

    def hashes_of(batch):
        for x in batch.column(0).to_pylist():
            yield np.array([x * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64)

    held = blooms.Filter(1 << 16, blooms.repeated(df, hashes_of, 1 << 16))
    asked = np.array([x * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for x in range(350)], np.uint64)
    got = held.has(asked)
    assert got[:50].all()
    assert got[50:].mean() < 0.1


def test_membership(spark):
    bits = blooms.bits_for(100)
    held = blooms.Filter(bits, blooms.membership(spark.range(0, 100, 1, 4).select((F.col("id") * 7919).alias("h")), bits))
    assert held.has((np.arange(100) * 7919).astype(np.uint64)).all()
    assert blooms.bits_for(1 << 40) == blooms.MOST_BITS


def test_rolling_hashes_know_equal_runs():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = np.concatenate([x[40:90], x])
    a, b = words.rolling(x, 50), words.rolling(y, 50)
    assert a[40] == b[0] == b[90]
    assert len(np.unique(np.concatenate([a, b]))) == len(b) - 1
    assert words.rolling(x[:3], 5).size == 0
    swapped = x.copy()
    swapped[[3, 7]] = swapped[[7, 3]]
    assert words.rolling(swapped[:50], 50)[0] != a[0]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 43])
def test_sliding_min(width):
    x = np.random.default_rng(1).integers(0, 1000, 100).astype(np.uint64)
    want = [x[k : k + width].min() for k in range(100 - width + 1)]
    assert words.sliding_min(x, width).tolist() == want


def test_row_keys_are_found_again(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(0, 100, 1, 3).selectExpr("id % 10 AS k", "'x' AS text").write.parquet(path)
    scan = spark.read.parquet(path).where("k > 1")
    for df in (scan, scan.unionByName(scan).repartition(3), scan.limit(0)):
        keyed = common.with_row_keys(df, "key")
        one, two = (keyed.select("key", "k").collect() for _ in range(2))
        assert sorted(map(tuple, one)) == sorted(map(tuple, two))
        assert len({tuple(r["key"]) for r in one}) == df.count()
    before = len(list(tmp_path.iterdir()))
    assert "numbered" not in str(common.with_row_keys(scan, "key").inputFiles())
    assert len(list(tmp_path.iterdir())) == before


@pytest.mark.parametrize("gone", [0, 1, 60])
def test_rows_without_keys(spark, gone):
    df = spark.range(0, 60, 1, 3).select(F.struct(F.col("id").alias("f"), F.lit(1).alias("i")).alias("key"), "id")
    keys = df.where(F.col("id") < gone).select("key")
    assert sorted(r["id"] for r in blooms.without(df, keys, "key").collect()) == list(range(gone, 60))


def test_one_large_value_is_kept():
    made = []
    value = lambda k: common.only(k, lambda: made.append(k) or [k])
    assert value("a") is value("a")
    value("b")
    value("a")
    assert made == ["a", "b", "a"]


def test_scratch_is_removed(spark):
    scratch = []
    df = common.stored(spark.range(3), "gone", scratch)
    assert df.count() == 3
    assert len(scratch) == 1
    common.cleared(spark, scratch)
    assert not scratch
    with pytest.raises(Exception, match=r"."):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_batches_are_bounded_unless_the_session_says(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    common.bound_batches(spark)
    assert spark.conf.get(key) == str(common.BATCH)
    spark.conf.set(key, "77")
    common.bound_batches(spark)
    assert spark.conf.get(key) == "77"
    spark.conf.unset(key)
