"""The integrity guards over the directory of a real container, each with the damage that it sees.

The container holds columns made of ``events``; the SQL finds the same records from the table
itself, and says which of them the damage concerns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guards
from ..sources import container
from . import containers

B = containers.B

_written: dict[tuple[str, str], str] = {}


def directory(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The directory of the container, which is written once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
            "event_id",
            F.when(F.col("user_id") % 17 != 0, F.col("user_id") % 3 == 0).alias("flag"),
            (F.col("event_id") % B >= 2000).alias("late"),
            F.col("user_id").cast("int").alias("who"),
            F.floor(F.col("event_id") / 100).cast("int").alias("hundred"),
            (F.col("user_id") / 100).alias("price"),
            F.col("event_type").alias("kind"),
            (F.col("user_id") / 100).alias("repriced"),
            F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("label"),
        )
        path = container.write(df.withColumnRenamed("event_id", "__row"), containers._path(spark), row="__row", block=B, share=True, directory=True)
        _written[key] = path
    return container.directory_of(spark, _written[key])


#: For each guard: table, the rows that are changed, column and new value.
DAMAGE: dict[str, list[tuple[str, str, str, str]]] = {
    "header_checksum": [("manifest", "true", "header_sum_found", "'damaged'")],
    "directory_checksum": [("manifest", "true", "directory_sum_found", "'damaged'")],
    "block_checksum": [("blocks", "object_id = 3 AND logical_count = 4096", "checksum_found", "'damaged'")],
    "object_count": [("manifest", "true", "n_objects", "1000001L")],
    "directory_length": [("manifest", "true", "n_blocks", "n_blocks + 1")],
    "block_offsets": [("blocks", "sequence = 1", "start_at", "start_at + 4")],
    "compressed_smaller": [("blocks", "sequence = 0", "compression", "1L")],
    "declared_block_size": [("manifest", "true", "block_size", "100L")],
    "block_range": [("objects", "object_id = 8", "block_count", "block_count + 1")],
    "numeric_length": [("blocks", "object_id = 3", "logical_count", "logical_count + 1")],
    "logical_length": [("blocks", "sequence = 0", "logical_count", "logical_count - 1")],
    "string_length": [("blocks", "object_id = 8 AND logical_count = 4096", "logical_count", "logical_count - 1")],
    "string_count": [("blocks", "object_id = 8", "decoded_len", "4 * logical_count")],
    "children_range": [("objects", "object_id = 0", "child_count", "child_count + 1")],
    "depth": [("objects", "object_id = 4", "depth", "1001L")],
    "frame_rows": [("objects", "object_id = 4", "logical_len", "logical_len + 1")],
    "attribute_range": [("attributes", "name = 'class'", "value_object", "99L")],
    "reference_target": [("objects", "object_id = 7", "shared_with", "9L")],
    "metadata_length": [("manifest", "true", "metadata_bytes", "70000L")],
    "delta_width": [("codes", "encoding IN ('delta', 'frame')", "width", "33L")],
    "int_run_end": [("codes", "encoding = 'int_runs'", "last_end", "last_end + 1")],
    "logical_run_end": [("codes", "encoding = 'logical_runs'", "ends_rise", "0L")],
    "string_record_length": [("codes", "encoding = 'records'", "record_bytes", "record_bytes + 1")],
    "dict_index_range": [("codes", "encoding = 'index'", "top_id", "entries")],
    "zstd_length": [("codes", "sequence = 0", "frame_len", "7L"), ("blocks", "sequence = 0", "compression", "1L")],
    "alp_exception_position": [("codes", "encoding = 'decimal'", "top_position", "5000L")],
}

#: What the damage shows, from the records that ``events`` gives.
SEEN: dict[str, str] = {
    "header_checksum": "SELECT 'damaged' AS wanted",
    "directory_checksum": "SELECT 'damaged' AS wanted",
    "block_checksum": f"SELECT sequence, checksum FROM blocks JOIN (SELECT event_id // {B} AS blk, sha256(string_agg(sha256(CAST(user_id AS VARCHAR)), '' ORDER BY event_id)) AS checksum FROM events GROUP BY event_id // {B}) AS s USING (blk) WHERE object_id = 3 AND n = 4096",
    "object_count": "SELECT 1000001::BIGINT AS n_objects, 11::BIGINT AS found",
    "directory_length": "SELECT count(*) + 1 AS n_blocks, count(*) AS found FROM blocks",
    "block_offsets": "SELECT sequence, start_at + CASE WHEN sequence = 1 THEN 4 ELSE 0 END AS start_at FROM blocks WHERE sequence IN (1, 2)",
    "compressed_smaller": "SELECT sequence, len AS stored_len, len AS decoded_len FROM blocks WHERE sequence = 0",
    "declared_block_size": "SELECT sequence, len AS decoded_len FROM blocks WHERE len > 100",
    "block_range": "SELECT 8::BIGINT AS object_id, min(sequence) AS first_block, count(*) + 1 AS block_count FROM blocks WHERE object_id = 8",
    "numeric_length": "SELECT 3::BIGINT AS object_id, CAST(sum(n) AS BIGINT) AS logical_len, CAST(sum(n) + count(*) AS BIGINT) AS found FROM blocks WHERE object_id = 3",
    "logical_length": "SELECT 1::BIGINT AS object_id, count(*) AS logical_len, count(*) - 1 AS found FROM events",
    "string_length": f"SELECT 8::BIGINT AS object_id, count(*) AS logical_len, count(*) - count(*) // {B} AS found FROM events HAVING count(*) >= {B}",
    "string_count": "SELECT sequence, n AS logical_count, 4 * n AS decoded_len FROM blocks WHERE object_id = 8",
    "children_range": "SELECT 0::BIGINT AS object_id, 9::BIGINT AS child_count, 8::BIGINT AS found",
    "depth": "SELECT 4::BIGINT AS object_id, 1001::BIGINT AS depth",
    "frame_rows": "SELECT 4::BIGINT AS object_id, count(*) + 1 AS logical_len, count(*) AS wanted FROM events",
    "attribute_range": "SELECT 0::BIGINT AS owner, 'class' AS name, 99::BIGINT AS value_object",
    "reference_target": "SELECT 7::BIGINT AS object_id, 9::BIGINT AS shared_with",
    "metadata_length": "SELECT 70000::BIGINT AS metadata_bytes",
    "delta_width": "SELECT sequence, 33::BIGINT AS width FROM blocks WHERE encoding IN ('delta', 'frame')",
    "int_run_end": "SELECT sequence, n + 1 AS last_end FROM blocks WHERE encoding = 'int_runs'",
    "logical_run_end": "SELECT sequence, n AS last_end FROM blocks WHERE encoding = 'logical_runs'",
    "string_record_length": "SELECT sequence, len + 1 AS record_bytes FROM blocks WHERE encoding = 'records'",
    "dict_index_range": "SELECT sequence, (SELECT count(DISTINCT event_type) FROM events) AS top_id, (SELECT count(DISTINCT event_type) FROM events) AS entries FROM blocks WHERE encoding = 'index'",
    "zstd_length": "SELECT sequence, 7::BIGINT AS frame_len, len AS decoded_len FROM blocks WHERE sequence = 0",
    "alp_exception_position": "SELECT sequence, 5000::BIGINT AS top_position FROM blocks WHERE encoding = 'decimal'",
}


def damaged(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    out = dict(tables)
    for table, where, column, value in DAMAGE[name]:
        out[table] = out[table].withColumn(column, F.when(F.expr(where), F.expr(value)).otherwise(F.col(column)))
    return out


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = guards.violations(spark, name, damaged(directory(spark, sf_dir), name))
        return found.select("wanted") if name in ("header_checksum", "directory_checksum") else found

    run.__name__ = f"guard_{name}"
    return run


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the guards that the container breaks as it was written: none."""
    tables = directory(spark, sf_dir)
    return spark.createDataFrame([(n,) for n in guards.check(spark, tables)], "guard string")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column that another one's object refers to, and its own: objects 4 and 7."""
    directory(spark, sf_dir)
    path = _written[(spark.sparkContext.applicationId, sf_dir)]
    return container.read_targets(spark, path, [4, 7]).where("__row < 500").withColumnRenamed("__row", "place")
