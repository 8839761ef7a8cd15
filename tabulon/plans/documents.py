"""From files to records: which readers see a document, which see it again, and what is tried last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import ai
from tabulon.operators.cascade import waves
from tabulon.sources import readers
from tabulon.sources.templates import RegexField, LinesField, Template


def _areas(templates: Sequence[Template]) -> bool:
    return any(getattr(f, "area", None) for t in templates for f in t.fields if isinstance(f, (RegexField, LinesField)))


def read_documents(
    spark: SparkSession, path: str, templates: Sequence[Template], reader: str | None = None, last_resorts: Sequence[str] | None = None,
    provider: ai.Provider | None = None, pattern: str = "*",
) -> DataFrame:
    """Records of all files below a path; ``doc_id`` is the file's path.

    Text files are read as they are, others by the readers that are there, quickest first: a later one
    sees only what no earlier one made a whole record of. A template that names a reader is honoured by
    reading its documents again with that one. With ``reader`` only that one is used, whatever templates
    say (KeyError if it is unknown). Documents without a record then go to the last resorts (recognition
    of pictures, as far as it is there) and, where a ``provider`` is given, to a language model;
    ``extraction_method`` says which way a record came. A file that can't be read has the error no_text.
    """
    files = readers.read_folder(spark, path, pattern).select(F.col("path").alias("doc_id"), "content")
    boxes = _areas(templates)
    if last_resorts is None:
        last_resorts = [n for n in readers.LAST_RESORTS if readers.READERS[n].available() and n != reader][:1]

    def texts_of(docs: DataFrame, name: str) -> DataFrame:
        return readers.reader_texts(docs, [name], boxes=boxes).drop("reader", "reader_rank", "read_error")

    if reader is not None:
        found = waves(texts_of, files, templates, readers.resolve("", reader), pins=False, last_resorts=last_resorts)
    else:
        plain = F.lower("doc_id").endswith(".txt")
        texts = waves(texts_of, files.where(plain), templates, ["text"], pins=False)
        others = waves(texts_of, files.where(~plain), templates, readers.resolve("."), last_resorts=last_resorts)
        found = texts.unionByName(others)
    if provider is None:
        return found.withColumn("extraction_method", F.when(F.col("record").isNotNull(), "template"))
    left = files.join(found.where("record is null").select("doc_id"), "doc_id", "left_semi")
    first = F.when(F.lower("doc_id").endswith(".txt"), "text").otherwise(reader or readers.resolve(".")[0])
    sample = None
    for name in {"text", reader or readers.resolve(".")[0]}:
        some = readers.reader_texts(left.where(first == name), [name]).select("doc_id", "text")
        sample = some if sample is None else sample.unionByName(some)
    return ai.fill_in(found, sample, provider)
