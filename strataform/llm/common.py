"""What the training-data operators share: tables, shared storage, words and rows.

Word rule used by several operators: a word is a maximal run of characters
outside ``[\\x20\\x09-\\x0D]``.  ``bytes.split()`` cuts at exactly that set, so
UTF-8 bytes are split in C without a regular expression.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word, for Java and DuckDB regular expressions.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or that of ``setCheckpointDir``.

    Only on one machine, and only where the session leaves it unset, a temporary folder is
    chosen and kept for the session; on a cluster that would be another folder on each machine.
    """
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get("strataform.shared.dir", None)
    if not conf:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all machines share")
        conf = "file://" + tempfile.mkdtemp(prefix="strataform-")
        spark.conf.set("strataform.shared.dir", conf)
    return conf.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strataform/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    This cuts the lineage: later jobs read the files, which outlive any executor.  Paths that
    no result needs in the end are listed in ``scratch``, for ``cleared``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession, scratch: list[str]) -> None:
    while scratch:
        removed(spark, scratch.pop())


def with_row_keys(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a key for each row, struct<f, i>, that every read of the rows finds again.

    Rows straight from files are known by their file and place in it, and are not copied;
    others are numbered and written out.
    """
    if _plain_scan(docs):
        return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")))
    return stored(docs.withColumn(name, F.struct(F.lit(0).cast("bigint").alias("f"), F.monotonically_increasing_id().alias("i"))), "numbered")


def _plain_scan(docs: DataFrame) -> bool:
    """Whether the rows are those of files, at most filtered and projected."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if not plan.nodeName().startswith(("Relation", "LogicalRelation")):
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


_slot: dict[str, Any] = {}


def only(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one large value that this process keeps from task to task; asking for another drops it."""
    if _slot.get("key") != key:
        _slot.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # what has been freed goes back to the system
            ctypes.CDLL(None).malloc_trim(0)
        _slot["value"] = make()
        _slot["key"] = key
    return _slot["value"]


def encoded(column: pa.Array) -> list[bytes | None]:
    """The texts of a column as UTF-8, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1000, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has few rows and, unless one row is larger, few bytes."""
    for batch in batches:
        start, n = 0, batch.num_rows
        while start < n:
            take = min(rows, n - start)
            piece = batch.slice(start, take)
            while take > 1 and piece.nbytes > limit:
                take = max(1, take // 2)
                piece = batch.slice(start, take)
            yield piece
            start += take


#: Rows of the Arrow batches that go to Python workers, where the session does not say.
BATCH = 3000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH`` rows, unless it has a number of its own.

    Texts are long: ten thousand of them, Spark's default, take tens of megabytes in each
    worker and again outside the heap of its executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: The driver takes in values of at most so many bytes together.
AT_ONCE = 256 << 20


def tree_merge(df: DataFrame, column: str, merge: Callable[[bytes, bytes], bytes], bound: int) -> bytes | None:
    """One binary value folded over all rows, of which a partition of ``df`` has one.

    ``bound`` is the most bytes that a value may have.  Of many partitions the values are
    written out and executors fold groups of them until few are left.  The driver takes in as
    many of the rest at a time as it can hold.  Both hold a bounded number of bytes at any size.
    """
    spark, scratch = df.sparkSession, []
    held = df.select(column)
    group = max(2, min(64, (AT_ONCE >> 2) // bound))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column(0):
                total = cell.as_py() if total is None else merge(total, cell.as_py())
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.binary())], [column])

    if held.rdd.getNumPartitions() > 64:
        held = stored(held, "values", scratch)
        while (n := held.count()) > 64:
            held = stored(held.repartition(-(-n // group)).mapInArrow(fold, f"{column} binary"), "values", scratch)
    total = None
    for row in _rows_in_waves(held, max(1, AT_ONCE // bound)):
        total = bytes(row[0]) if total is None else merge(total, bytes(row[0]))
    cleared(spark, scratch)
    return total


def _rows_in_waves(df: DataFrame, wave: int) -> Iterator[Any]:
    """The rows of ``df``, some partitions at a time and these all at once, without Python workers of its own."""
    from pyspark.util import _load_from_socket

    context, rdd = df.sparkSession.sparkContext, df.rdd
    for a in range(0, n := rdd.getNumPartitions(), wave):
        found = context._jvm.PythonRDD.runJob(context._jsc.sc(), rdd._jrdd, list(range(a, min(n, a + wave))))
        yield from _load_from_socket(found, rdd._jrdd_deserializer)
