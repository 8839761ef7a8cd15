"""Operator 3: documents packed into sequences of balanced attention cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import bpe, shared

#: Tokens of a sequence, and sequences that are packed together.
CAPACITY, SEQUENCES = 4096, 256
#: Cost of n tokens of one document in a sequence: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place of each length, taken in the given (descending) order.

    Each goes to the sequence of lowest cost that has room, of equal ones to the first. There are as
    many sequences at first as the tokens need; one more opens when no sequence has room.
    """
    n = len(lengths)
    some = max(1, -(-int(lengths.sum()) // capacity))
    cost, room = np.full(some + n, np.inf), np.full(some + n, capacity, np.int64)
    cost[:some] = 0.0
    sequence, place = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, length in enumerate(lengths.tolist()):
        best = int(np.argmin(np.where(room[:some] >= length, cost[:some], np.inf)))
        if room[best] < length:
            best, some = some, some + 1
            cost[best] = 0.0
        sequence[i], place[i] = best, capacity - room[best]
        room[best] -= length
        cost[best] += linear * length + quadratic * length * length
    return sequence, place


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, sequences: int = SEQUENCES, linear: float = LINEAR, quadratic: float = QUADRATIC, vocabulary: str = bpe.DEFAULT_VOCABULARY, id_column: str = "doc_id", text_column: str = "text", work: shared.Workspace | None = None) -> DataFrame:
    """Packs every document's tokens into sequences of at most ``capacity`` tokens.

    A document longer than a sequence is cut into full pieces and a rest. Pieces fall by a hash of
    their document, place among the input's rows and number into groups of about ``sequences``
    sequences, as many groups as the tokens need, so that an id repeated often spreads too; a group
    is packed as :func:`assign` says, longest first, of equal lengths the smaller id, piece and row
    first, null ids last. Only ids and counts are shuffled; ids are carried as they came.

    Result: the id column, ``piece``, ``token_start``, ``n_tokens``, ``bin`` (group), ``sequence``
    (in its group), ``sequence_offset`` and ``cost``. A text without tokens (null, empty) has one row
    with piece 0, no tokens and null bin, sequence and offset. Repeated rows and null ids are packed
    each on its own. Other columns are ignored. An empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType
    work = work or shared.Workspace(spark, "packing")
    schema = T.StructType([T.StructField("id", kind), T.StructField("row", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        encoder = bpe.encoder(vocabulary)
        for batch in batches:
            n = encoder.count(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(row + np.arange(len(n))), pa.array(n)], names=schema.names)
            row += len(n)

    counted = work.table(docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(count, schema), "counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-int(total) // (capacity * sequences)))
    last = F.expr(f"greatest(0, (n - 1) div {int(capacity)})").cast("int")
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = pieces.withColumn("token_start", F.col("piece").cast("bigint") * capacity).withColumn("n_tokens", F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("token_start")))
    pieces = pieces.withColumn("bin", F.when(F.col("n") > 0, F.pmod(F.xxhash64(F.col("id").cast("string"), "row", "piece"), F.lit(bins))))
    columns = [T.StructField(id_column, kind), T.StructField("piece", T.IntegerType()), T.StructField("token_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("sequence", T.LongType()), T.StructField("sequence_offset", T.LongType()), T.StructField("cost", T.DoubleType())]

    def greedy(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, sort_keys=[("n_tokens", "descending"), ("id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        group = group.take(order)
        lengths = group["n_tokens"].to_numpy()
        sequence, place = assign(lengths, capacity, linear, quadratic)
        made = [pa.array(sequence), pa.array(place), pa.array(linear * lengths + quadratic * lengths * lengths)]
        return pa.table([*[group[c] for c in ("id", "piece", "token_start", "n_tokens", "bin")], *made], names=[c.name for c in columns])

    packed = pieces.where("n > 0").select("id", "row", "piece", "token_start", "n_tokens", "bin").groupBy("bin").applyInArrow(greedy, T.StructType(columns))
    empty = pieces.where("n = 0").select(F.col("id").alias(id_column), "piece", "token_start", "n_tokens", F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("bigint").alias("sequence"), F.lit(None).cast("bigint").alias("sequence_offset"), F.lit(0.0).alias("cost"))
    return packed.unionByName(empty)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's places in sequences of 4,096 tokens; nulls, ties and repeated rows as :func:`pack` says."""
    return pack(spark, shared.load(spark, sf_dir, "documents"))
