"""A training-data pipeline over ``documents``: each stage reads what the one before it kept.

Stages take (spark, docs, sf_dir) and return a table with the columns of documents, the last
one the encoded texts.  ``run`` writes each stage's table as Parquet and reads it again.

Each stage decides row by row: rows that repeat or share an id, and null ids, stay rows of their
own.  A null or empty text is clean, has one empty line, is no near copy, has no words and no
ids.  An empty table gives an empty table; extra columns go along, and clash with nothing but
names that begin with ``_row`` or ``_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataform.llm import blooms, jaccard_join, line_dedup, mixing, sentencepiece_codec, toxicity
from strataform.llm.common import stored, table, with_row_keys


def _columns(docs: DataFrame) -> list[str]:
    return docs.columns


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the toxicity score does not reject; each row is judged by its own text, whatever its id."""
    rows = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("_row"))
    kept = toxicity.score(rows, table(spark, sf_dir, "labels"), carry=("_row", "text")).where("predicted = 0")
    return kept.select("_row.*", "text").select(*_columns(docs))


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which a line that ten documents or more share is left in the first of them only.

    The first row has the smallest id, a null id being the largest; then the smaller hash of the
    text; equal rows are interchangeable.  No row goes, even if it is left without text.
    """
    keyed = with_row_keys(docs, "_row_key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_row_key")
    rows = keyed.select(F.struct(*(c for c in docs.columns if c != "text")).alias("_row"), "text", order.alias("_row_order"))
    out = line_dedup.dedup_lines(rows, id_col="_row", order_col="_row_order", keep="first").select("doc_id.*", F.col("text").alias("_row_text"))
    n_chars = {"n_chars": F.length("_row_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns({**n_chars, "text": F.col("_row_text")}).select(*_columns(docs))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows without words stay.

    It has the smallest id, a null id being the largest, then the smallest digest of the set of
    shingles, then of the text; equal rows are interchangeable.
    """
    keyed = with_row_keys(docs, "_row_key")
    found = jaccard_join.jaccard_components(keyed, row_col="_row_key").where("cls is not null")
    found = stored(found.select("label", "doc_id", "cls", "row"), "found")
    # Only groups of several rows have one to choose.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")
    several = found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).where("n > 1").drop("n")
    member = stored(found.join(several, "label").select("label", "row", (place == F.col("least")).alias("first")), "members")
    first = member.where("first").select("row", "label")
    hashes = keyed.select(F.col("_row_key").alias("row"), F.xxhash64("text").alias("_hash"))
    chosen = first.join(hashes, "row").groupBy("label").agg(F.min(F.struct("_hash", "row")).alias("best")).select(F.col("best.row").alias("row"))
    gone = member.select("row").join(chosen, "row", "left_anti").withColumnRenamed("row", "_row_key")
    return blooms.without(keyed, gone, "_row_key").select(*_columns(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as its source's share of the mix takes it; repeated rows are rounded each."""
    keyed = with_row_keys(docs, "_row_key")
    taken = mixing.mix(keyed, row_col="_row_key").where("copies > 0").select(F.col("row").alias("_row_key"), F.col("copies").alias("_copies"))
    both = keyed.join(taken, "_row_key")
    return both.withColumn("_copies_k", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*_columns(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each text, decoded again and compared; copies of a document are drawn apart."""
    # Texts without ids need no number, and would be one large group under a null id.
    blank = F.when(F.coalesce("text", F.lit("")) == "", F.monotonically_increasing_id())
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), blank.alias("_blank"))
    copies = Window.partitionBy("doc_id", "_h", "_blank").orderBy("doc_id")
    return sentencepiece_codec.round_trip(docs.withColumn("_copy", F.row_number().over(copies)), copy_col="_copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("line dedup", lines_out),
    ("n-gram jaccard join", near_copies_out),
    ("mixing sources", mixed),
    ("sentencepiece", encoded),
]

#: Scores learned from labels, Newton steps and the merge agenda have no SQL: tests hold run() against a brute-force version on small tables, and each stage against brute force or planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
