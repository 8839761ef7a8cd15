"""Operator 5: quality rules as a learned decision list over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import kernels as K
from tabulon.llm import shared

#: Labelled documents whose statistics are fitted at most.
ROWS = 20_000

STATISTICS = ("n_bytes", "n_words", "mean_word", "upper_share", "sign_share", "digit_share", "bar_share", "blank_share", "repeat_share", "distinct_share", "line_copies", "mean_line")

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(97, 123)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[9, 10, 13, 32]] = 4
_KIND[[*range(128, 256)]] = 5


def _copies(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n)


def measure(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text, over its whole length; all zero for null and empty texts."""
    n = len(column)
    data, offsets = K.utf8(column)
    size = np.diff(offsets)
    kind = _KIND[data]
    row = np.repeat(np.arange(n), size)
    per_kind = np.bincount(row * 6 + kind, minlength=6 * n).reshape(n, 6) if n else np.zeros((0, 6))
    bars = np.bincount(row[data == 124], minlength=n)
    starts, ends, owner = K.words(data, offsets)
    words = np.bincount(owner, minlength=n)
    letters = np.bincount(owner, ends - starts, minlength=n)
    h = K.span_hashes(data, starts, ends)
    again = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[1:][again], minlength=n)
    distinct = _copies(h, owner, n)
    cut = np.flatnonzero(data == 10)
    edge = np.unique(np.concatenate([offsets, cut, cut + 1]))
    a, b = edge[:-1], edge[1:]
    line = data[a] != 10 if len(a) else np.zeros(0, bool)
    a, b = a[line], b[line]
    of = np.searchsorted(offsets, a, side="right") - 1
    lines = np.bincount(of, minlength=n)
    kinds = _copies(K.span_hashes(data, a, b), of, n)
    one = np.maximum(size, 1)
    some, per_line = np.maximum(words, 1), np.maximum(lines, 1)
    cased = np.maximum(per_kind[:, 1] + per_kind[:, 2], 1)
    return np.column_stack([
        size, words, letters / some, per_kind[:, 1] / cased, per_kind[:, 0] / one, per_kind[:, 3] / one, bars / one,
        per_kind[:, 4] / one, repeats / some, distinct / some, (lines - kinds) / per_line, size / per_line,
    ]).astype(np.float64)


def with_statistics(docs: DataFrame, keep: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """Adds the columns of STATISTICS, in a struct ``__stats`` that replaces any column of this name."""
    kept = [c for c in keep or docs.columns if c != "__stats"]
    inner = T.StructType([T.StructField(name, T.DoubleType()) for name in STATISTICS])
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("__stats", inner)])
    source = shared.numbered(docs.select(*[docs[c] for c in kept], docs[text_column]))[0]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(part) for part in K.slices(K.strings(batch.column(batch.num_columns - 1)))]
            values = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            stats = pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(len(STATISTICS))], names=list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], stats], names=schema.names)

    return source.mapInArrow(apply, schema)


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, STATISTICS.index(self.statistic)]
        return value >= self.threshold if self.at_least else value < self.threshold

    def column(self, stats: str = "__stats") -> Column:
        value = F.col(f"{stats}.{self.statistic}")
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information that a condition adds about the positives it leaves."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: np.ndarray, y: np.ndarray, longest: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest:
        xs, ys = x[inside], y[inside]
        p0, n0 = ys.sum(), (~ys).sum()
        if not p0 or not n0:
            break
        best, found = 1e-9, None
        for k, name in enumerate(STATISTICS):
            order = np.argsort(xs[:, k], kind="stable")
            v, p = xs[order, k], np.cumsum(ys[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            below_p, below_n = p[cut], cut + 1 - p[cut]
            middle = (v[cut] + v[cut + 1]) / 2
            for at_least, pp, nn in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                gain = _gain(p0, n0, pp.astype(float), nn.astype(float))
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, found = gain[i], Condition(name, at_least, float(middle[i]))
        if found is None:
            break
        rule.append(found)
        inside &= found.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The shortest prefix of the highest (positives - negatives) / all that it covers of the pruning rows."""
    best, value = rule, -2.0
    for size in range(1, len(rule) + 1):
        inside = _covers(rule[:size], x)
        p, n = (y & inside).sum(), (~y & inside).sum()
        worth = (p - n) / max(1, p + n)
        if worth > value + 1e-12:
            best, value = rule[:size], worth
    return best


def learn(x: np.ndarray, y: np.ndarray, precision: float = 0.9, longest: int = 4, most: int | None = None, fewest: int = 3) -> list[Rule]:
    """Ordered rules for the positives ``y``: grown on two thirds of the rows left, pruned on a third.

    A rule is kept if, of all rows left, it covers at least ``fewest`` positives at this precision;
    rows it covers then leave. Learning ends at the first rule that doesn't, or at ``most`` rules if a number is given;
    ``longest`` bounds the conditions of a rule.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 0
    while (most is None or len(rules) < most) and (y & left).any():
        grow, prune = left & ~third, left & third
        rule = _prune(_grow(x[grow], y[grow], longest), x[prune], y[prune])
        inside = left & _covers(rule, x) if rule else np.zeros(len(x), bool)
        p = (y & inside).sum()
        if p < fewest or p < precision * inside.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, precision: float = 0.9, longest: int = 4, most: int | None = None, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> list[Rule]:
    """Rules for documents labelled 0, from at most about ``rows`` labelled documents; the rest as in :func:`learn`.

    Chosen by the least hash of their id; null ids, labels and texts are left out. No rules come of
    an empty table, of labels of one kind, or where none is precise enough.
    """
    known = labels.select(labels[id_column].alias("id"), labels[label_column].cast("int").alias("label")).where("id is not null and label is not null").distinct()
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.shiftrightunsigned(F.xxhash64("id"), 11) < int(share * (1 << 53)))
    texts = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).where("text is not null")
    # The chosen rows are about ``rows`` at most, whatever the input.
    joined = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")
    found = with_statistics(joined, keep=["id", "label"]).select("label", F.xxhash64("id").alias("order"), "__stats.*").toArrow().to_pandas()
    found = found.sort_values(["order", "label", *STATISTICS], kind="stable")
    return learn(found[list(STATISTICS)].to_numpy(), found["label"].to_numpy() == 0, precision, longest, most)


def matched(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        condition = rule[0].column()
        for more in rule[1:]:
            condition &= more.column()
        out = F.when(condition, F.lit(k)) if out is None else out.when(condition, F.lit(k))
    return out if out is not None else F.lit(None).cast("int")


def judge(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """Adds ``rule`` (number of the first rule that holds, else null) and ``accepted`` (none does).

    Every row gets both, null and empty texts by statistics of zero. Columns of ``docs`` with these
    names are replaced, all others come back as they are; ``keep`` limits them. Repeated rows are
    judged each; where several rules hold the first one counts.
    """
    kept = [c for c in keep or docs.columns if c not in ("rule", "accepted")]
    plain, _ = shared.numbered(docs.select(*[docs[c] for c in kept], docs[text_column]))
    every = plain.columns
    out = with_statistics(plain, every[:-1], every[-1]).select(*every[:-1], matched(rules).alias("rule"))
    return out.select(*every[:-1], "rule", F.col("rule").isNull().alias("accepted")).toDF(*kept, "rule", "accepted")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that no rule rejects, with the columns they came with.

    Null and empty texts are judged by statistics of zero, repeated rows all alike. Without labels of
    both kinds nothing is rejected; an empty table stays empty.
    """
    rules = fit(docs, shared.load(spark, sf_dir, "labels"))
    plain, names = shared.numbered(docs)
    found = judge(plain, rules, text_column=names["text"])
    return found.where("accepted").select(*plain.columns).toDF(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that rejects each document, learned from the labelled ones; nulls as :func:`judge` says."""
    docs = shared.load(spark, sf_dir, "documents")
    return judge(docs, fit(docs, shared.load(spark, sf_dir, "labels")), keep=["doc_id"])
