"""The same extraction over documents as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.functions.text import clean_reader_text
from tabulon.plans.engine import extract
from tabulon.sources.templates import Template


def arriving_texts(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Text files that appear below a folder: ``doc_id`` (path) and ``text``."""
    found = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return found.select(F.col("_metadata.file_path").alias("doc_id"), clean_reader_text(F.col("value")).alias("text"))


def extract_stream(docs: DataFrame, templates: Sequence[Template], target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes every document's extraction as JSON lines; extraction keeps no state, so late documents need no watermark.

    A restarted query goes on from its checkpoint; each batch is written once.
    """
    found = extract(docs, templates).withColumn("record", F.to_json("record"))
    writer = found.drop("text").writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
