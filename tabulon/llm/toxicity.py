"""Operator 4: toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import kernels as K
from tabulon.llm import shared

BITS = 20
#: Labelled documents that are fitted at most, and bytes of their slots in the driver.
ROWS, SLOT_BYTES = 12_000, 192 << 20
THRESHOLD = 0.2

_SECOND, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slot and row of every word, of every two neighbours, and of every two words with one between."""
    h, row = K.hashed_words(column)
    slots, rows = [h], [row]
    for gap, salt in ((1, _SECOND), (2, _SKIP)):
        same = row[gap:] == row[:-gap]
        slots.append(K.mix(h[:-gap][same] * salt + h[gap:][same]))
        rows.append(row[gap:][same])
    return (np.concatenate(slots) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """FTRL-proximal over sets of slots, with a rate for each slot and L1 sparsity."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / rate, 0.0)

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Slots and weights that L1 left, and the bias."""
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, epochs: int = 3, bits: int = BITS, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", slot_bytes: int = SLOT_BYTES) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from at most about ``rows`` labelled documents, those with the least hash of their id.

    Of these as many are fitted, in the order of the hash, as have ``slot_bytes`` bytes of slots
    together (4 for each distinct word, pair and skip-pair of a text): the driver holds no more. Ids
    may be of any type. Null ids, labels and texts are left out, a repeated id counts once for each
    label it has. Without labels of both kinds every weight is zero.
    """
    known = labels.select(labels[id_column].alias("id"), labels[label_column].cast("int").alias("label")).where("id is not null and label is not null").distinct()
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("id"), 11) < int(share * (1 << 53)))
    texts = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).where("text is not null")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first in zip(parts := list(K.slices(K.strings(batch.column(2)))), np.cumsum([0, *map(len, parts)])):
                at, row = features(part, bits)
                both = np.unique(row << bits | at)
                ends = np.searchsorted(both >> bits, np.arange(len(part) + 1))
                at = (both & ((1 << bits) - 1)).astype("<i4")
                own = batch.slice(int(first), len(part))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([at[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=["at", "label", "slots"])

    # The chosen rows are about ``rows`` at most, whatever the input.
    joined = texts.join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("at"), "label", "text")
    model = Ftrl(bits)
    with shared.closing():
        sample = shared.Workspace(docs.sparkSession, "toxicity").table(joined.mapInArrow(slots, "at bigint, label int, slots binary"), "sample")
        sizes = sample.select("at", F.octet_length("slots").alias("size")).toArrow().to_pandas()  # two numbers for each chosen row
        sizes = sizes.groupby("at")["size"].sum().sort_index().cumsum()
        fitting = sizes[sizes <= slot_bytes]
        found = sample.where(F.col("at") <= int(fitting.index[-1])).toArrow().to_pandas() if len(fitting) else None
    if found is not None and found["label"].nunique() == 2:
        found["order"] = K.mix(found["at"].to_numpy(np.int64).view(np.uint64))  # another order than rows are chosen by
        found = found.sort_values(["order", "label", "slots"]).drop_duplicates(["order", "label"])
        examples = [(np.frombuffer(s, "<i4"), int(y)) for s, y in zip(found["slots"], found["label"])]
        for _ in range(epochs):
            for at, y in examples:
                model.learn(at, y)
    return model.compact()


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], bits: int = BITS, threshold: float = THRESHOLD, keep: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """Adds ``toxicity`` (probability) and ``toxic`` (it exceeds ``threshold``) to every row.

    A text's features are the set of its slots over its whole length. Null and empty texts have the
    bias alone; repeated rows are judged each. Columns of ``docs`` with these two names are replaced; ``keep`` limits the others.
    """
    added = [("toxicity", T.DoubleType()), ("toxic", T.BooleanType())]
    kept = [c for c in keep or docs.columns if c not in {name for name, _ in added}]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(*x) for x in added])
    at, value, bias = weights
    source = shared.numbered(docs.select(*[docs[c] for c in kept], docs[text_column]))[0]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.float32)
        table[at] = value
        for batch in batches:
            sums = []
            for part in K.slices(K.strings(batch.column(batch.num_columns - 1))):
                slot, row = features(part, bits)
                hit = table[slot] != 0
                both = np.unique(row[hit] << bits | slot[hit])
                sums.append(np.bincount(both >> bits, table[both & ((1 << bits) - 1)], len(part)))
            p = 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(sums) + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array(p > threshold)], names=schema.names)

    return source.mapInArrow(apply, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, fitted on the labelled ones; nulls and empty texts as :func:`score` says."""
    docs = shared.load(spark, sf_dir, "documents")
    return score(docs, fit(docs, shared.load(spark, sf_dir, "labels")), keep=["doc_id"])
