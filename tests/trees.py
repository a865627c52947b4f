"""A small object graph: an archive of frames and a nested list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: object_id, parent_id, ordinal, name, type, logical_len, stored_bytes, shared_with, first_block, block_count
OBJECTS: list[tuple] = [
    (0, None, 1, None, "list", 3, 0, None, 0, 0),
    (1, 0, 1, "sales", "data.frame", 200, 0, None, 0, 0),
    (2, 0, 2, "models", "list", 2, 0, None, 0, 0),
    (3, 0, 3, "label", "character", 1, 40, None, 0, 1),
    (4, 1, 1, "day", "double", 200, 300, None, 1, 1),
    (5, 1, 2, "store", "factor", 200, 120, None, 2, 1),
    (6, 1, 3, "units", "integer", 200, 410, None, 3, 2),
    (7, 1, 4, "price", "double", 200, 0, 4, 0, 0),
    (8, 2, 1, None, "list", 1, 0, None, 0, 0),
    (9, 2, 2, "", "double", 6, 64, None, 5, 1),
    (10, 5, 1, "levels", "character", 4, 44, None, 6, 1),
    (11, 8, 1, "coef", "double", 2, 32, None, 7, 1),
]

OBJECT_SCHEMA = "object_id bigint, parent_id bigint, ordinal bigint, name string, type string, logical_len bigint, stored_bytes bigint, shared_with bigint, first_block bigint, block_count bigint"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(OBJECTS, OBJECT_SCHEMA)
