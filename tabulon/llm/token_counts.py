"""Operator 9: token counts by a cache of content digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, shared

#: Part of the version: a change of :func:`normalised` needs another number.
NORMALISATION = "1"


def normalised(text: Column) -> Column:
    """Line ends as LF, and no blanks, tabs or line ends at the end; null as empty."""
    unix = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.rtrim(unix, F.lit(" \t\n"))


def version(vocabulary: str) -> str:
    """Digest of all that a count depends on besides the content."""
    with open(vocabulary, "rb") as file:
        return hashlib.sha256(b"\0".join([file.read(), bpe.PATTERN.encode(), NORMALISATION.encode()])).hexdigest()[:32]


def _cached(spark: SparkSession, cache: str, mark: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={mark}")
    schema = "digest binary, n_tokens bigint"
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{cache}/version={mark}").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(spark: SparkSession, docs: DataFrame, cache: str, vocabulary: str = bpe.DEFAULT_VOCABULARY, id_column: str = "doc_id", text_column: str = "text", work: shared.Workspace | None = None) -> DataFrame:
    """Tokens of every document's normalised text; only contents that ``cache`` lacks are encoded.

    ``cache`` is a folder of Parquet files by tokenizer version. Digests (SHA-256 of the normalised
    text) are joined to it; of each distinct one that is missing the first row, by its place in the
    scan, is encoded where it lies and its count appended: only digests and places are shuffled. A
    scan that gives its rows in another order the second time is noticed by the digests, and what it
    left out is exchanged by digest and encoded then. A job that is cut short appends nothing; two
    jobs at once may append a digest twice, which reading folds.

    Result: the id column, ``digest`` (binary) and ``n_tokens``, one row per input row, null ids and
    repeated rows included. Null and empty texts count 0. Other columns are ignored.
    """
    kind = docs.schema[id_column].dataType
    cache = shared.qualified(spark, cache)
    mark, work = version(vocabulary), work or shared.Workspace(spark, "token-counts")
    text = normalised(docs[text_column])
    digest, place = F.unhex(F.sha2(text, 256)), F.monotonically_increasing_id()
    keys = work.table(docs.select(docs[id_column].alias("id"), digest.alias("digest"), place.alias("place")), "keys")
    first = keys.groupBy("digest").agg(F.min("place").alias("place"))
    lacking = first.join(_cached(spark, cache, mark), "digest", "left_anti")
    missing = work.table(lacking.repartitionByRange("place").sortWithinPartitions("place"), "missing")
    files = missing.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # a row a file
    n_missing = sum(f.n for f in files)
    if n_missing:
        ranges = [(f.path, f.a, f.b) for f in files]

        def wanted(place: int) -> pa.Table:
            """Places and digests that are missing from the partition of a place."""
            low, high = place >> 33 << 33, (place >> 33) + 1 << 33
            own = [_read(path, low, high) for path, a, b in ranges if a < high and b >= low]
            return pa.concat_tables([pa.table({"place": pa.array([], pa.int64()), "digest": pa.array([], pa.binary())}), *own]).sort_by("place")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, own = bpe.encoder(vocabulary), None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if own is None:
                    own = wanted(batch.column(0)[0].as_py())
                    places, used = own["place"].to_numpy(), np.zeros(len(own), bool)
                here = batch.column(0).to_numpy()
                rows = np.flatnonzero(np.isin(here, places))
                at = np.searchsorted(places, here[rows])
                texts, digests = batch.column(1).take(pa.array(rows)), own["digest"].take(pa.array(at)).to_pylist()
                same = []
                for k, t, d in zip(at.tolist(), texts.to_pylist(), digests):
                    same.append(not used[k] and hashlib.sha256(t.encode()).digest() == d)
                    used[k] |= same[-1]
                texts = texts.filter(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, s in zip(digests, same) if s], pa.binary()), pa.array(encoder.count(texts))], names=["digest", "n_tokens"])

        done = Observation()
        counted = docs.select(place.alias("place"), text.alias("text")).mapInArrow(count, "digest binary, n_tokens bigint")
        counted.observe(done, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{cache}/version={mark}")
        if done.get["n"] < n_missing:
            _count_by_digest(spark, docs.select(digest.alias("digest"), text.alias("text")), missing, cache, mark, vocabulary)
    found = keys.join(_cached(spark, cache, mark), "digest").select("id", "digest", "n_tokens")
    return found.select(F.col("id").cast(kind).alias(id_column), "digest", "n_tokens")


def _read(path: str, low: int, high: int) -> pa.Table:
    files, at = pa.fs.FileSystem.from_uri(path)
    found = pq.read_table(at, filesystem=files, columns=["place", "digest"], filters=[("place", ">=", low), ("place", "<", high)], partitioning=None)
    return found.cast(pa.schema([("place", pa.int64()), ("digest", pa.binary())]))


def _count_by_digest(spark: SparkSession, texts: DataFrame, missing: DataFrame, cache: str, mark: str, vocabulary: str) -> None:
    """Appends what is still missing, one text for each digest, whatever the order of rows."""
    left = missing.select("digest").join(_cached(spark, cache, mark), "digest", "left_anti")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder.count(batch.column(1)))], names=["digest", "n_tokens"])

    some = texts.join(left.hint("shuffle_hash"), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    some.mapInArrow(count, "digest binary, n_tokens bigint").write.mode("append").parquet(f"{cache}/version={mark}")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by a cache that starts empty at each call, so that all distinct texts are encoded."""
    work = shared.Workspace(spark, "token-cache")
    return count_tokens(spark, shared.load(spark, sf_dir, "documents"), f"{work.path}/cache")
