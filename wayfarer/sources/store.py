"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes an execution's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders made here, by application.
_OWN: dict[str, str] = {}


class _Open(threading.local):
    """Folders of steps that the thread's temporary() blocks will delete, innermost last: streams run in threads of their own."""

    def __init__(self):
        self.blocks: list[list[str]] = []


_OPEN = _Open()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where spark.checkpoint.dir is unset and Spark runs in this one process is a folder made here.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="wayfarer-")
        _OWN[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def _files(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def is_there(spark: SparkSession, *tables: DataFrame) -> bool:
    """Whether the files of these steps are still there."""
    return all(files.exists(path) for path, files in (_files(spark, t._step) for t in tables))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes the steps that are made inside at its end: for results that have been written by then."""
    _OPEN.blocks.append([])
    try:
        yield
    finally:
        for name in _OPEN.blocks.pop():
            path, files = _files(spark, name)
            files.delete(path, True)


class Steps:
    """Intermediate tables in the shared folder; each cuts the lineage and outlives lost executors. What is left of them is deleted when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/wayfarer-{name}-{uuid.uuid4().hex}"
        self.count = 0
        if _OPEN.blocks:
            _OPEN.blocks[-1].append(self.base)
        path, files = _files(spark, self.base)
        files.deleteOnExit(path)  # what a result still reads goes with the application at the latest

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        conf, before = self.spark.conf, self.spark.conf.get(CLEAN_UP, None)
        conf.set(CLEAN_UP, "true")  # what is written is read from its files: its shuffles can go
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(CLEAN_UP, before) if before is not None else conf.unset(CLEAN_UP)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._step = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in tables:
            path, files = _files(self.spark, df._step)
            files.delete(path, True)
