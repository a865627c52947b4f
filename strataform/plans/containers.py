"""Queries that write real containers in the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import container
from ..sources.storage import shared_folder

B = 4096


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/containers/{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, **options) -> str:
    return container.write(_table(spark, sf_dir, "events"), _path(spark), row="event_id", block=B, **options)


def metadata_rows(spark: SparkSession, metadata: dict[str, str]) -> DataFrame:
    """key and value of checked metadata."""
    held = container.check_metadata(metadata)
    return spark.createDataFrame([(held,)], "m map<string,string>").select(F.explode("m").alias("key", "value"))


def container_roundtrip(spark, sf_dir):
    return container.read(spark, _events(spark, sf_dir))


def container_select_window(spark, sf_dir):
    return container.read(spark, _events(spark, sf_dir), select=["value", "event_id"], window=(4000, 4200))


def container_positions(spark, sf_dir):
    return container.read(spark, _events(spark, sf_dir), select=[1, 4], positions=[9, 2, 2, 901], keep_row=True).withColumnRenamed("__row", "place")


def container_shared(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_totalprice").alias("again"))
    path = container.write(df, _path(spark), row="o_orderkey", block=B, share=True)
    return container.schema(spark, path).select("path", "depth", "type", "shared_with")


def container_info(spark, sf_dir):
    path = _events(spark, sf_dir, metadata={"owner": "data team"})
    return container.info(spark, path).select("format_version", "codec", "block_size", "object_count", "root_type", "root_length", F.col("metadata")["owner"].alias("owner"), "authoritative")


def container_schema(spark, sf_dir):
    path = container.save(_path(spark), {"region": _table(spark, sf_dir, "region"), "nation": _table(spark, sf_dir, "nation")}, order={"region": ["r_regionkey"], "nation": ["n_nationkey"]})
    return container.schema(spark, path).select("path", "depth", "type", "length", "shape")


def archive_load(spark, sf_dir):
    tables = {"region": _table(spark, sf_dir, "region"), "nation": _table(spark, sf_dir, "nation"), "customer": _table(spark, sf_dir, "customer")}
    path = container.save(_path(spark), tables, order={"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"]})
    return container.load(spark, path, ["nation"])["nation"]


def archive_objects(spark, sf_dir):
    """The object table of an archive of three tables."""
    tables = {t: _table(spark, sf_dir, t) for t in ("region", "nation", "customer")}
    path = container.save(_path(spark), tables, order={"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"]})
    return container.objects(spark, path)


def verify_ok(spark, sf_dir):
    return container.verify(spark, _events(spark, sf_dir), content=True).agg(F.count(F.lit(1)).alias("bad_blocks"))


def skip_unchanged(spark, sf_dir):
    path = _path(spark)
    df = _table(spark, sf_dir, "nation")
    seen = []
    for data, metadata in ((df, None), (df, None), (df, {"k": "v"}), (df.withColumn("n_name", F.lower("n_name")), {"k": "v"})):
        container.write(data, path, row="n_nationkey", metadata=metadata, skip_unchanged=True)
        seen.append(container.manifest_of(spark, path)["version"])
    return spark.createDataFrame([(k, k > 0 and seen[k] == seen[k - 1]) for k in range(4)], "write bigint, skipped boolean")


def opaque_roundtrip(spark, sf_dir):
    value = {"f": (1, 2.5, "x"), "n": [None, True], "b": b"\x00\x01"}
    path = container.write(value, _path(spark), spark=spark)
    back = container.read_opaque(spark, path, loads=True)
    return spark.createDataFrame([(back == value, container.manifest_of(spark, path)["codec"])], "same boolean, codec string")


def bytes_roundtrip(spark, sf_dir):
    data = container.serialize(_table(spark, sf_dir, "nation").orderBy("n_nationkey"))
    return container.unserialize(spark, data, select=["n_name"], positions=[3, 0, 3])


def container_any_order(spark, sf_dir):
    path = container.write(_table(spark, sf_dir, "nation"), _path(spark), order=["n_name"])
    return container.read(spark, path, window=(3, 9), keep_row=True).withColumnRenamed("__row", "place")


def container_as_found(spark, sf_dir):
    return container.read(spark, container.write(_table(spark, sf_dir, "nation"), _path(spark)))


def vector_roundtrip(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    path = container.write_vector(df, _path(spark), row="event_id", names="event_type", block=B)
    return container.read_vector(spark, path, window=(100, 4500), names=True).withColumnRenamed("__row", "place")


def vector_positions(spark, sf_dir):
    path = container.write_vector(_table(spark, sf_dir, "events").select("event_id", "value"), _path(spark), row="event_id", block=B)
    return container.read_vector(spark, path, positions=[7, 0, 7]).withColumnRenamed("__row", "place")


def row_names_stored(spark, sf_dir):
    path = container.write(_table(spark, sf_dir, "nation"), _path(spark), row="n_nationkey", row_names="n_name")
    return container.read(spark, path, select=["n_regionkey"], positions=[4, 2], row_names=True).withColumnRenamed("__name", "name")


def row_names_counted(spark, sf_dir):
    return container.read(spark, _events(spark, sf_dir), select=["event_id"], window=(50, 60), row_names=True).withColumnRenamed("__name", "name")


QUERIES = [
    (vector_roundtrip, "SELECT event_id AS place, user_id AS value, event_type AS name FROM events WHERE event_id BETWEEN 100 AND 4500"),
    (vector_positions, "SELECT CAST(p.place AS BIGINT) AS place, value FROM (VALUES (0, 7), (1, 0), (2, 7)) AS p(place, pos) JOIN events ON event_id = p.pos"),
    (row_names_stored, "SELECT n_name AS name, n_regionkey FROM nation WHERE n_nationkey IN (4, 2)"),
    (row_names_counted, "SELECT CAST(event_id - 49 AS VARCHAR) AS name, event_id FROM events WHERE event_id BETWEEN 50 AND 60"),
    (container_any_order, "SELECT * FROM (SELECT row_number() OVER (ORDER BY n_name) - 1 AS place, * FROM nation) AS t WHERE place BETWEEN 3 AND 9"),
    (container_as_found, "SELECT * FROM nation"),
    (container_roundtrip, "SELECT * FROM events"),
    (container_select_window, "SELECT value, event_id FROM events WHERE event_id BETWEEN 4000 AND 4200"),
    (container_positions, "SELECT CAST(p.place AS BIGINT) AS place, event_id, event_type FROM (VALUES (0, 9), (1, 2), (2, 2), (3, 901)) AS p(place, pos) JOIN events ON event_id = p.pos"),
    (container_shared, "SELECT * FROM (VALUES ('', CAST(0 AS BIGINT), 'data.frame', NULL), ('$o_orderkey', 1, 'bigint', NULL), ('$o_totalprice', 1, 'double', '$again'), ('$again', 1, 'double', NULL)) AS t(path, depth, type, shared_with)"),
    (container_info, "SELECT CAST(1 AS BIGINT) AS format_version, 'native' AS codec, CAST(4096 AS BIGINT) AS block_size, CAST(1 AS BIGINT) AS object_count, 'data.frame' AS root_type, count(*) AS root_length, 'data team' AS owner, true AS authoritative FROM events"),
    (container_schema, "SELECT * FROM (VALUES ('', CAST(0 AS BIGINT), 'list', CAST(2 AS BIGINT), '2'), ('$region', 1, 'data.frame', 5, '5 x 2'), ('$region$r_regionkey', 2, 'int', 5, '5'), ('$region$r_name', 2, 'string', 5, '5'), ('$nation', 1, 'data.frame', 25, '25 x 3'), ('$nation$n_nationkey', 2, 'int', 25, '25'), ('$nation$n_name', 2, 'string', 25, '25'), ('$nation$n_regionkey', 2, 'int', 25, '25')) AS t(path, depth, type, length, shape)"),
    (archive_load, "SELECT * FROM nation"),
    (verify_ok, "SELECT CAST(0 AS BIGINT) AS bad_blocks"),
    (skip_unchanged, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), false), (1, true), (2, false), (3, false)) AS t(write, skipped)"),
    (opaque_roundtrip, "SELECT true AS same, 'opaque' AS codec"),
    (bytes_roundtrip, "SELECT n_name FROM (VALUES (0, 3), (1, 0), (2, 3)) AS p(place, pos) JOIN nation ON n_nationkey = p.pos"),
]
