"""Object graphs as tables: paths, subtrees, selections, references and attributes.

objects: object_id, parent_id, ordinal (place under its parent), name, type, logical_len,
stored_bytes, shared_with (object that holds the value, or null).
attributes: owner, ordinal, name, value_object.
Graphs are at most 1,000 levels deep, and walked level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, LimitError
from ..sources.storage import stored

MOST_DEPTH = 1000


def step_text(name: Column, ordinal: Column) -> Column:
    """``$name``, or ``[[place]]`` where there is no name."""
    return F.when(name.isNotNull() & (name != ""), F.concat(F.lit("$"), name)).otherwise(F.concat(F.lit("[["), ordinal.cast("string"), F.lit("]]")))


def tree(objects: DataFrame) -> DataFrame:
    """objects with path, depth and sort_key, which orders them depth first."""
    return objects.sparkSession.sql(
        f"""
        WITH RECURSIVE walk(object_id, path, depth, sort_key) MAX RECURSION LEVEL {MOST_DEPTH + 1} AS (
          SELECT object_id, CAST('' AS STRING), 0, CAST('' AS STRING) FROM {{objects}} WHERE parent_id IS NULL
          UNION ALL
          SELECT o.object_id, concat(w.path, CASE WHEN o.name IS NOT NULL AND o.name <> '' THEN concat('$', o.name) ELSE concat('[[', CAST(o.ordinal AS STRING), ']]') END),
            w.depth + 1, concat(w.sort_key, '/', lpad(CAST(o.ordinal AS STRING), 7, '0'))
          FROM walk w JOIN {{objects}} o ON o.parent_id = w.object_id)
        SELECT o.*, w.path, CAST(w.depth AS BIGINT) AS depth, w.sort_key FROM {{objects}} o JOIN walk w ON o.object_id = w.object_id""",
        objects=objects,
    )


def closure(objects: DataFrame) -> DataFrame:
    """ancestor and descendant of every object, itself included; one join a level."""
    level = objects.select(F.col("object_id").alias("ancestor"), F.col("object_id").alias("descendant"))
    out = level
    children = objects.where("parent_id is not null").select(F.col("parent_id").alias("_p"), F.col("object_id").alias("_c"))
    for _ in range(MOST_DEPTH + 1):
        level = level.join(children, level["descendant"] == children["_p"]).select("ancestor", F.col("_c").alias("descendant"))
        if not level.limit(1).count():
            return out
        out = out.unionByName(level)
    raise LimitError(f"the graph is more than {MOST_DEPTH} levels deep")


def subtree_bytes(objects: DataFrame) -> DataFrame:
    """object_id and the bytes of it and all below it."""
    own = objects.select(F.col("object_id").alias("descendant"), "stored_bytes")
    return closure(objects).join(own, "descendant").groupBy(F.col("ancestor").alias("object_id")).agg(F.sum("stored_bytes").cast("bigint").alias("stored_bytes"))


def wanted(objects: DataFrame, roots: list[int]) -> DataFrame:
    """object_id of the roots, all below them, and what they refer to, until nothing is added.

    Each round looks at what the last one added, and is written out.
    """
    new = have = stored(objects.where(F.col("object_id").isin([int(r) for r in roots])).select("object_id"), "wanted")
    for _ in range(2 * MOST_DEPTH + 1):
        below = objects.join(new.withColumnRenamed("object_id", "parent_id"), "parent_id", "left_semi").select("object_id")
        targets = objects.join(new, "object_id", "left_semi").where("shared_with is not null").select(F.col("shared_with").alias("object_id"))
        new = stored(below.unionByName(targets).distinct().join(have, "object_id", "left_anti"), "wanted")
        if not new.limit(1).count():
            return have
        have = stored(have.unionByName(new), "wanted")
    raise LimitError("the selection did not settle")


def resolved(objects: DataFrame) -> DataFrame:
    """objects with value_id: the object that holds the value."""
    return objects.withColumn("value_id", F.coalesce("shared_with", "object_id"))


def find(objects: DataFrame, path: list[str | int]) -> int:
    """The object at a path of names and 1-based places; references are followed.

    One lookup a step; the step that fails is named.
    """
    here = objects.where("parent_id is null").select("object_id").first()["object_id"]
    for k, step in enumerate(path, 1):
        row = objects.where(F.col("object_id") == here).select("shared_with").first()
        here = row["shared_with"] if row["shared_with"] is not None else here
        below = objects.where(F.col("parent_id") == here)
        test = (F.col("name") == step) if isinstance(step, str) else (F.col("ordinal") == int(step))
        found = below.where(test).orderBy("ordinal").select("object_id").first()
        if found is None:
            raise ArgumentError(f"step {k} of the path, {step!r}, leads nowhere")
        here = found["object_id"]
    return int(here)


def attributes_of(objects: DataFrame, attributes: DataFrame, owner: int) -> DataFrame:
    """name, value_object and logical_len of the attributes of an object, in their order."""
    own = attributes.where(F.col("owner") == owner)
    return own.join(objects.select(F.col("object_id").alias("value_object"), "logical_len"), "value_object").select("ordinal", "name", "value_object", "logical_len")


def block_owner(objects: DataFrame, blocks: DataFrame) -> DataFrame:
    """sequence of each block with its object.

    Blocks of an object are contiguous, so the range condition is an equality with the
    positions it stands for; no pairs outside the ranges are made.
    """
    held = objects.where("block_count > 0").select("object_id", F.explode(F.sequence(F.col("first_block"), F.col("first_block") + F.col("block_count") - 1)).alias("sequence"))
    return blocks.join(held, "sequence")
