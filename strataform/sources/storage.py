"""Files through Spark's own file systems, so that any store that Spark reaches will do."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import StorageError


class Store:
    """A few file operations on the file system of a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name) if name else self.root

    def exists(self, name: str = "") -> bool:
        return bool(self.fs.exists(self._path(name)))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.root)] if self.exists() else []

    def age(self, name: str) -> float:
        """Seconds since the file or folder was last changed."""
        return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def size(self, name: str = "") -> int:
        return int(self.fs.getContentSummary(self._path(name)).getLength())

    def read(self, name: str) -> bytes:
        if not self.exists(name):
            raise StorageError(f"{self._path(name).toString()} is not there")
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def replace(self, name: str, data: bytes) -> None:
        """Writes a sibling file and renames it over ``name``, so that readers see the old file or the new one."""
        draft = self._path(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        target = self._path(name)
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.fs.getConf())
            options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
            options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
            context.rename(draft, target, options)
        except Exception:
            self.fs.delete(target, False)
            if not self.fs.rename(draft, target):
                self.fs.delete(draft, False)
                raise StorageError(f"{target.toString()} could not be replaced") from None


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` or of ``setCheckpointDir``; only on one machine, if unset, a temporary one."""
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("strataform.shared.dir", None)
    if not conf:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise StorageError("on a cluster spark.checkpoint.dir has to name a folder that all machines share")
        conf = "file://" + tempfile.mkdtemp(prefix="strataform-")
        spark.conf.set("strataform.shared.dir", conf)
    return conf.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in the shared folder and read again, so that each later read finds the same rows."""
    path = f"{shared_folder(df.sparkSession)}/strataform/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
