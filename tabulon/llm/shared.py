"""Folders and tables that all executors share, and small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where the session names none, a folder set with setCheckpointDir is used; a local session
    without either gets a temporary folder; a cluster without either is refused, as a folder of
    the driver's machine would not be seen by its executors.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return qualified(spark, named)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return qualified(spark, current.get())
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tabulon-"))
    return qualified(spark, context._jsc.sc().getCheckpointDir().get())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark gives it, so that Python's file systems and Spark's mean the same place."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return re.sub("^file:/(?!//)", "file:///", full)


class Workspace:
    """Tables of one run below the shared folder; reading them back cuts the lineage.

    Results read from it, so it stays until :meth:`close`; :func:`closing` closes all that a block opens.
    """

    #: Those that are open, oldest first.
    opened: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Workspace.opened.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A folder made now, for files that tasks write themselves."""
        path = f"{self.path}/{name}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(at)
        return path

    def close(self) -> None:
        """Deletes all of it; what reads from it must be done."""
        if self in Workspace.opened:
            Workspace.opened.remove(self)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def closing(*kept: Workspace) -> Iterator[None]:
    """Closes the workspaces opened within, but for ``kept``: for callers who write a result and are done with what made it."""
    before = [*Workspace.opened, *kept]
    try:
        yield
    finally:
        for work in [w for w in Workspace.opened if w not in before]:
            work.close()


def numbered(frame: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns named by number, so that no name can clash, and the numbers by name."""
    names = [f"column{k}" for k in range(len(frame.columns))]
    return frame.toDF(*names), dict(zip(frame.columns, names))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
