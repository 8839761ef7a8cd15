"""Tables that one step writes and the next one reads, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, or what setCheckpointDir has set; a local session without either gets a folder of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tabulon-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


class Staging:
    """A folder for one run's tables; what is read from it needs it until :meth:`close`."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        """The frame as written and read again: its lineage is cut, and nothing before it runs twice."""
        frame.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def close(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
