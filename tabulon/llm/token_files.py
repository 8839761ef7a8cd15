"""Operator 1: token ids as flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import bpe, shared


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


def write_token_files(spark: SparkSession, docs: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY, id_column: str = "doc_id", text_column: str = "text", work: shared.Workspace | None = None) -> DataFrame:
    """Writes one pair of files per input partition and returns every document's place.

    ``<shard>.bin`` holds the ids of the partition's documents end to end (16-bit if the vocabulary
    fits, else 32-bit, little-endian); ``<shard>.idx`` holds n+1 unsigned 64-bit offsets. A shard's
    base among all tokens is the prefix sum of the shards before it; ``manifest`` keeps the bases.

    Result: the id column, ``shard``, ``shard_offset`` (tokens before it in its file),
    ``token_offset`` (tokens before it in the corpus) and ``n_tokens``; one row per input row,
    repeated and null ids included. Null and empty texts have no tokens. Other columns of ``docs``
    are ignored, whatever their names. An empty table gives no files and no rows.

    A task writes under a name of its own and reports it with its rows, so of a retried task only
    the attempt whose rows were committed counts; files of other attempts are deleted.
    """
    work = work or shared.Workspace(spark, "tokens")
    folder = work.folder("files")
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("part", T.IntegerType()), T.StructField("shard", T.StringType()), T.StructField("shard_offset", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        shard = f"tokens-{part:06d}-{uuid.uuid4().hex}"
        encoder, (files, at) = bpe.encoder(vocabulary), _open(folder)
        ids, counts, out = [], [], None
        for batch in batches:
            if out is None:
                out = files.open_output_stream(f"{at}/{shard}.bin")
            tokens, offsets = encoder.encode(batch.column(1))
            out.write(tokens.tobytes())
            ids.append(batch.column(0))
            counts.append(np.diff(offsets))
        if out is None:
            return
        out.close()
        ends = np.cumsum(np.concatenate(counts), dtype=np.uint64)
        with files.open_output_stream(f"{at}/{shard}.idx") as index:
            index.write(np.concatenate([np.zeros(1, np.uint64), ends]).astype("<u8").tobytes())
        before = 0
        for one, n in zip(ids, counts):
            places = before + np.cumsum(n) - n
            before += int(n.sum())
            m = len(n)
            yield pa.RecordBatch.from_arrays([one, pa.array(np.full(m, part, np.int32)), pa.array([shard] * m, pa.string()), pa.array(places), pa.array(n)], names=schema.names)

    source = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    index = work.table(source.mapInArrow(encode, schema), "index")
    sums = index.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    bases = sums.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    bases = work.table(bases.withColumn("bits", F.lit(8 * bpe.encoder(vocabulary).dtype.itemsize)), "manifest")
    live = {row.shard for row in bases.select("shard").toLocalIterator()}
    files, at = _open(folder)
    for info in files.get_file_info(pa.fs.FileSelector(at)):
        if info.base_name.rpartition(".")[0] not in live:
            files.delete_file(info.path)
    placed = index.join(bases.select("part", "base"), "part")
    return placed.select(F.col("id").alias(id_column), "shard", "shard_offset", (F.col("base") + F.col("shard_offset")).alias("token_offset"), "n_tokens")


class TokenFiles:
    """Memory-mapped reading of what :func:`write_token_files` wrote below ``path``."""

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")
        rows = sorted(pq.read_table(f"{self.path}/manifest").to_pylist(), key=lambda r: r["part"])
        self.shards = [r["shard"] for r in rows]
        self.bases = np.array([r["base"] for r in rows], np.uint64)
        self.dtype = np.dtype(f"<u{rows[0]['bits'] // 8}") if rows else np.dtype("<u2")
        self._maps: dict[str, np.ndarray] = {}

    def shard(self, name: str) -> np.ndarray:
        if name not in self._maps:
            at = f"{self.path}/files/{name}.bin"
            with open(at, "rb") as file:
                self._maps[name] = np.memmap(at, self.dtype, "r") if file.read(1) else np.zeros(0, self.dtype)
        return self._maps[name]

    def offsets(self, name: str) -> np.ndarray:
        return np.memmap(f"{self.path}/files/{name}.idx", "<u8", "r")

    def read(self, token_offset: int, n_tokens: int) -> np.ndarray:
        """Tokens at a place in the corpus; the range lies in one shard."""
        k = int(np.searchsorted(self.bases, np.uint64(token_offset), side="right")) - 1
        at = token_offset - int(self.bases[k])
        return self.shard(self.shards[k])[at : at + n_tokens]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files; nulls and repeated rows as :func:`write_token_files` says."""
    return write_token_files(spark, shared.load(spark, sf_dir, "documents"))
