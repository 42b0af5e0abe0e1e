"""The folder that driver and executors share, and tables written there between rounds."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on one machine (tests)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    own = getattr(spark.sparkContext, "_newsloom_shared", None)
    if own is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = spark.sparkContext._newsloom_shared = "file://" + tempfile.mkdtemp(prefix="newsloom-shared-")
    return own


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_newsloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="newsloom-"), "newsloom_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("newsloom", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._newsloom_shipped = True


def ship(function):
    """function, after this package was sent to the executors."""
    ship_package(SparkSession.getActiveSession())
    return function


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, a function that makes its paths)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at(path), True)


_JOB: ContextVar[str | None] = ContextVar("newsloom_job", default=None)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Tables that are settled inside go to one folder, which is deleted at the end: for work whose result is written before that."""
    folder = f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"
    token = _JOB.set(folder)
    try:
        yield folder
    finally:
        _JOB.reset(token)
        remove(spark, folder)


#: Makes Spark drop a query's shuffle files when the query is over.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read back: cuts the lineage and survives lost executors. The write's shuffle files go as soon as the table stands."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, name: str = "round") -> DataFrame:
    """df as a table in the shared folder: what an iteration goes on from."""
    return written(df, f"{_JOB.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


class Scratch:
    """Tables of one job in one folder below the shared one; drop() removes single ones, close() the rest."""

    def __init__(self, spark: SparkSession, name: str = "scratch"):
        self.spark, self.path = spark, f"{_JOB.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._at: dict[int, tuple[DataFrame, str]] = {}

    def settle(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{len(self._at)}-{uuid.uuid4().hex[:8]}"
        out = written(df, path)
        self._at[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            known = self._at.pop(id(t), None)
            if known:
                remove(self.spark, known[1])

    def close(self) -> None:
        remove(self.spark, self.path)
        self._at.clear()
