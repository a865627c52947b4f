"""Containers: round trips, selective reads proved by damage, hashes, and failures that leave the old one."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.errors import ArgumentError, FormatError, LimitError, UnsupportedError, VersionError
from strataform.sources import container
from strataform.streaming import sink


@pytest.fixture
def frame(spark):
    return spark.range(0, 5000, 1, 3).select(F.col("id").alias("row"), (F.col("id") * 7 % 100).cast("int").alias("n"), F.when(F.col("id") % 5 != 0, F.col("id") / 4).alias("x"), F.concat(F.lit("s"), F.col("id") % 13).alias("s"))


def test_round_trip(spark, frame, tmp_path):
    path = container.write(frame, str(tmp_path / "c"), row="row", block=1000, metadata={"k": "v"})
    back = container.read(spark, path)
    assert back.dtypes == frame.dtypes
    assert back.orderBy("row").collect() == frame.orderBy("row").collect()
    assert container.verify(spark, path, content=True).count() == 0
    assert container.manifest_of(spark, path)["metadata"] == {"k": "v"}
    assert [n for n in os.listdir(path) if n.startswith(".manifest") and not n.endswith(".crc")] == []


@pytest.mark.parametrize("positions", [[], [0], [4999, 0, 17, 17], [999, 1000, 1001]])
def test_positions_equal_indexing(spark, frame, tmp_path, positions):
    path = container.write(frame, str(tmp_path / "c"), row="row")
    got = container.read(spark, path, select=["n", "row"], positions=positions, keep_row=True).orderBy("__row").collect()
    assert [(r["n"], r["row"]) for r in got] == [(p * 7 % 100, p) for p in positions]


def test_refusals(spark, frame, tmp_path):
    path = container.write(frame, str(tmp_path / "c"), row="row")
    for bad in ({"select": ["nope"]}, {"positions": [5000]}, {"select": [9]}, {"positions": [1], "window": (0, 1)}):
        with pytest.raises(ArgumentError):
            container.read(spark, path, **bad)
    with pytest.raises(ArgumentError):
        container.write(frame, path, row="row", compress=20)
    with pytest.raises(ArgumentError):
        container.write(frame, path, row="row", skip_unchanged=True, hash=False)
    with pytest.raises(ArgumentError):
        container.write(frame.where("row <> 3"), path, row="row")
    with pytest.raises(ArgumentError):
        container.write(frame.withColumn("row", F.when(F.col("row") == 70, 69).otherwise(F.col("row"))), path, row="row")
    with pytest.raises(UnsupportedError):
        container.write([1, 2], path, spark=spark, mode="strict")
    assert container.read(spark, path).count() == 5000


def test_rows_in_any_order_and_as_found(spark, tmp_path):
    some = [("b", None), ("a", 2.0), (None, 1.0), ("a", None), ("b", 0.5)]
    df = spark.createDataFrame(some, "k string, v double").coalesce(1)
    path = container.write(df, str(tmp_path / "c"), order=["k", "v"])
    assert [tuple(r) for r in container.read(spark, path, keep_row=True).orderBy("__row").select("k", "v").collect()] == [(None, 1.0), ("a", None), ("a", 2.0), ("b", None), ("b", 0.5)]
    path = container.write(df, str(tmp_path / "d"))
    assert [tuple(r) for r in container.read(spark, path, keep_row=True).orderBy("__row").select("k", "v").collect()] == some


def test_hash_tells_nested_microseconds_and_shapes(spark):
    time = lambda k: f"array(timestamp_ntz'2020-01-01 00:00:00.00000{k}')"
    forms = [time(1), time(2), "array(null)", "cast(null as array<string>)", "array()", "array('a','b')", "array('a,1:b')", "named_struct('x', null, 'y', 'z')", "named_struct('x', 'z', 'y', null)", "map('a', 1, 'b', 2)", "map('a', 1, 'b', 3)"]
    hashes = [container.table_hash(spark.sql(f"select 0L as row, {e} as v"), row="row") for e in forms]
    assert len(set(hashes)) == len(forms)
    assert container.table_hash(spark.sql("select 0L as row, map('b', 2, 'a', 1) as v"), row="row") == hashes[9]


def test_values_of_equal_content_have_one_form():
    c = container.canonical_value
    assert c({"a": 1, "b": (2, None)}) == c({"b": (2, None), "a": 1})
    assert c({1, 2, 3}) == c({3, 2, 1})
    different = [1, 1.0, True, "1", b"1", [1], (1,), {1}, {1: 1}, [[1], []], [[], [1]], 0.0, -0.0, None, "", []]
    assert len({c(x) for x in different}) == len(different)


@pytest.mark.parametrize("metadata", [{"": "x"}, {"a": None}, {1: "a"}, {"a": "b\0"}])
def test_metadata_refused(metadata):
    with pytest.raises(ArgumentError):
        container.check_metadata(metadata)


def test_metadata_limits():
    assert container.check_metadata({"é": ""}) == {"é": ""}
    with pytest.raises(LimitError):
        container.check_metadata({"a": "x" * 70_000})
    with pytest.raises(LimitError):
        container.check_metadata({str(k): "" for k in range(1025)})


def _parts(path, version):
    folder = f"{path}/{version}/data/0"
    return sorted(f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".parquet"))


def _damage(name, column):
    """Flips a byte in the middle of the first page of a column."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(name).metadata
    place = meta.schema.names.index(column)
    chunk = meta.row_group(0).column(place)
    start = chunk.data_page_offset if chunk.dictionary_page_offset is None else min(chunk.data_page_offset, chunk.dictionary_page_offset)
    at = start + chunk.total_compressed_size // 2
    with open(name, "r+b") as f:
        f.seek(at)
        b = f.read(1)
        f.seek(at)
        f.write(bytes([b[0] ^ 0x55]))
    folder, base = os.path.split(name)
    crc = f"{folder}/.{base}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_damage_outside_the_request_is_not_read(spark, tmp_path):
    df = spark.range(0, 60_000, 1, 1).select(F.col("id").alias("row"), (F.hash("id") % 1000).alias("a"), F.hash("id", F.lit(1)).alias("b"))
    path = container.write(df, str(tmp_path / "c"), row="row")
    for name in _parts(path, container.manifest_of(spark, path)["version"]):
        _damage(name, "a")
    spark.catalog.clearCache()
    assert container.read(spark, path, select=["b"]).where("b is not null").count() == 60_000
    with pytest.raises(Exception, match=r"."):
        container.read(spark, path, select=["a"]).agg(F.sum("a")).collect()


def test_inspection_reads_no_data(spark, frame, tmp_path):
    path = container.write(frame, str(tmp_path / "c"), row="row", attributes={"unit": "EUR"})
    version = container.manifest_of(spark, path)["version"]
    for name in _parts(path, version):
        os.remove(name)
    assert container.info(spark, path).first()["root_length"] == 5000
    assert [r["path"] for r in container.schema(spark, path).collect()] == ["", "$row", "$n", "$x", "$s"]
    assert container.attributes(spark, path) == {"names": ["row", "n", "x", "s"], "class": "data.frame", "unit": "EUR"}
    assert container.attributes(spark, path, names=["unit"]) == {"unit": "EUR"}
    with pytest.raises(ArgumentError, match="'nothing'"):
        container.attributes(spark, path, names=["unit", "nothing"])


def test_hash_properties(spark, frame):
    base = container.table_hash(frame, row="row", block=512)
    assert container.table_hash(frame.repartition(7), row="row", block=512) == base
    assert container.table_hash(frame.coalesce(1), row="row", block=512) == base
    changed = [
        frame.withColumn("n", F.when(F.col("row") == 77, 101).otherwise(F.col("n")).cast("int")),
        frame.withColumn("n", F.col("n").cast("bigint")),
        frame.withColumnRenamed("s", "t"),
        frame.withColumn("x", F.when(F.col("row") == 0, F.lit(-0.0)).otherwise(F.col("x"))),
        frame.withColumn("s", F.when(F.col("row") == 0, F.lit(None)).otherwise(F.col("s"))),
        frame.select("row", "x", "n", "s"),
        frame.withColumn("n", (99 - F.col("n")).cast("int")),
        frame.limit(0),
    ]
    hashes = [container.table_hash(df, row="row", block=512) for df in changed]
    assert len({base, *hashes}) == 1 + len(hashes)


def test_skip_unchanged_and_versions(spark, frame, tmp_path):
    path = str(tmp_path / "c")
    container.write(frame, path, row="row", skip_unchanged=True)
    one = container.manifest_of(spark, path)["version"]
    container.write(frame.repartition(5), path, row="row", skip_unchanged=True)
    assert container.manifest_of(spark, path)["version"] == one
    container.write(frame, path, row="row", metadata={"a": "b"}, skip_unchanged=True)
    two = container.manifest_of(spark, path)["version"]
    assert two != one
    versions = lambda: {n for n in os.listdir(path) if n.startswith("v-")}
    assert versions() == {one, two}  # a reader of the old one can still finish
    os.mkdir(f"{path}/v-open")
    container.write(frame, path, row="row", metadata={"c": "d"})
    three = container.manifest_of(spark, path)["version"]
    assert versions() == {two, three, "v-open"}  # another writer's stays
    os.utime(f"{path}/v-open", (1, 1))
    container.write(frame, path, row="row")
    assert versions() == {three, container.manifest_of(spark, path)["version"]}


def test_tampered_manifests(spark, frame, tmp_path):
    import json

    path = container.write(frame.limit(10), str(tmp_path / "c"), row="row")
    name = f"{path}/manifest.json"
    good = json.load(open(name))

    def put(data):
        for f in (name, f"{path}/.manifest.json.crc"):
            if os.path.exists(f):
                os.remove(f)
        with open(name, "wb") as f:
            f.write(data)

    put(json.dumps(good | {"body": good["body"].replace('"rows": 10', '"rows": 11')}).encode())
    with pytest.raises(FormatError):
        container.read(spark, path)
    put(container.seal(json.loads(good["body"]) | {"format": 99}))
    with pytest.raises(VersionError):
        container.read(spark, path)
    put(b"{")
    with pytest.raises(FormatError):
        container.read(spark, path)


def test_verify_names_the_block(spark, frame, tmp_path):
    path = container.write(frame, str(tmp_path / "c"), row="row", block=1000)
    version = container.manifest_of(spark, path)["version"]
    folder = f"{path}/{version}/data/0"
    changed = spark.read.parquet(folder).withColumn("n", F.when(F.col("row") == 2500, 101).otherwise(F.col("n")).cast("int"))
    changed.write.parquet(f"{path}/other")
    os.rename(folder, f"{path}/old")
    os.rename(f"{path}/other", folder)
    assert [tuple(r) for r in container.verify(spark, path).collect()] == [(0, 2)]
    with pytest.raises(FormatError):
        container.verify(spark, path, content=True)


def test_archive(spark, frame, tmp_path):
    other = spark.createDataFrame([(0, "x"), (1, None)], "row bigint, t string")
    path = container.save(str(tmp_path / "a"), {"frame": frame, "other": other}, row="row")
    assert sorted(container.load(spark, path)) == ["frame", "other"]
    assert [r["t"] for r in container.load(spark, path, ["other"])["other"].orderBy("row").collect()] == ["x", None]
    with pytest.raises(ArgumentError, match="'x', 'y'"):
        container.load(spark, path, ["x", "y"])
    with pytest.raises(ArgumentError):
        container.save(str(tmp_path / "b"), {})
    assert [r["path"] for r in container.schema(spark, path, recursive=False).collect()] == ["", "$frame", "$other"]
    assert container.attributes(spark, path, ["other"])["names"] == ["row", "t"]


def test_sharing(spark, frame, tmp_path):
    df = frame.withColumn("again", F.col("n"))
    path = container.write(df, str(tmp_path / "c"), row="row", share=True)
    assert container.manifest_of(spark, path)["objects"][0]["shared"] == {"n": "again"}
    assert container.read(spark, path).orderBy("row").collect() == df.orderBy("row").collect()
    assert container.manifest_of(spark, path)["hash"] == container.table_hash(df, row="row")


def test_nested_columns_and_column_attributes(spark, tmp_path):
    kind = T.StructType([T.StructField("row", T.LongType()), T.StructField("sub", T.StructType([T.StructField("b", T.IntegerType()), T.StructField("c", T.StringType())])), T.StructField("m", T.DoubleType(), True, {"attributes": {"unit": "kg"}})])
    df = spark.createDataFrame([(0, (1, "x"), 0.5), (1, None, None)], kind)
    path = container.write(df, str(tmp_path / "c"), row="row")
    assert container.read(spark, path).orderBy("row").collect() == df.collect()
    assert container.read(spark, path, select=["m"]).schema["m"].metadata == {"attributes": {"unit": "kg"}}
    assert container.attributes(spark, path, ["m"]) == {"unit": "kg"}
    assert container.attributes(spark, path, ["sub"])["names"] == ["b", "c"]
    assert [r["path"] for r in container.schema(spark, path).collect()] == ["", "$row", "$sub", "$sub$b", "$sub$c", "$m"]


def test_empty_table(spark, frame, tmp_path):
    path = container.write(frame.limit(0), str(tmp_path / "c"), row="row")
    assert container.read(spark, path).count() == 0
    assert container.verify(spark, path, content=True).count() == 0


def test_opaque_values(spark, tmp_path):
    value = {"a": [1, 2, {"b": (3, None)}], "big": b"x" * (2 << 20)}
    path = container.write(value, str(tmp_path / "c"), spark=spark)
    assert container.read_opaque(spark, path, loads=True) == value
    row = container.info(spark, path).first()
    assert (row["codec"], row["authoritative"]) == ("opaque", False)
    assert "dict" in row["synopsis"]
    with pytest.raises(UnsupportedError):
        container.read(spark, path)


def test_bytes(spark, frame):
    data = container.serialize(frame.limit(20).orderBy("row"), metadata={"k": "v"})
    assert container.unserialize(spark, data).count() == 20
    assert [r["n"] for r in container.unserialize(spark, data, select=["n"], positions=[3, 3]).collect()] == [21, 21]
    with pytest.raises(FormatError):
        container.unserialize(spark, data[:-1] + b"?")
    assert container.unserialize(spark, container.serialize([1, None]), loads=True) == [1, None]
    assert isinstance(container.unserialize(spark, container.serialize([1, None])), bytes)
    with pytest.raises(LimitError):
        container.serialize(spark.range(1000), most=100)


def test_a_failed_write_keeps_the_old_container(spark, frame, tmp_path):
    path = container.write(frame, str(tmp_path / "c"), row="row")
    broken = frame.withColumn("n", F.when(F.col("row") > 4000, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="stop"):
        container.write(broken, path, row="row")
    assert container.read(spark, path).count() == 5000
    assert container.verify(spark, path).count() == 0


def test_streaming_sink(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).selectExpr("id", "id * 2 AS v").write.parquet(source)
    stream = spark.readStream.schema("id bigint, v bigint").parquet(source)
    q = sink.to_containers(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["id"])
    q.awaitTermination(120)
    found = sink.batches(spark, str(tmp_path / "out"))
    assert len(found) == 1
    assert container.read(spark, found[0]).agg(F.sum("v")).first()[0] == 9900
