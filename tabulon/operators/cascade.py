"""Several readers' texts of one document: the best extraction wins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.plans.engine import extract
from tabulon.plans.staging import Staging
from tabulon.sources.templates import Template


def best_run(runs: DataFrame, id_column: str = "doc_id", rank_column: str = "reader_rank") -> DataFrame:
    """For each document the complete run that has its lines, of the lowest rank; else the complete one of the lowest rank.

    Documents without a complete run get the lowest rank's error. Partial aggregation before the
    shuffle: one row for each document and task is sent, so leave out what isn't wanted of it.
    """
    order = F.struct(F.col("error").isNotNull().alias("a"), F.coalesce(F.col("lineless"), F.lit(False)).alias("b"), F.col(rank_column).alias("c"))
    rest = [c for c in runs.columns if c != id_column]
    return runs.groupBy(id_column).agg(F.min_by(F.struct(*rest), order).alias("best")).select(id_column, "best.*")


def without_texts(runs: DataFrame) -> DataFrame:
    """Without the columns that extraction has read: they are the largest, and would be shuffled."""
    return runs.drop("text", "boxes", "content")


def pinned(templates: Sequence[Template]) -> dict[str, str]:
    return {t.name: t.reader for t in templates if t.reader}


def _honoured(runs: DataFrame, pins: dict[str, str], reader_column: str) -> DataFrame:
    if not pins:
        return runs
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for p in pins.items() for x in p]), F.col("template_name"))
    return runs.where(wanted.isNull() | (wanted == F.col(reader_column)))


def cascade(texts: DataFrame, templates: Sequence[Template], id_column: str = "doc_id", rank_column: str = "reader_rank", reader_column: str = "reader", wanted: Mapping[str, Column] | None = None) -> DataFrame:
    """Extracts from every reader's text and keeps the best run; a template that names a reader takes only that reader's.

    The texts themselves aren't in the result. ``wanted`` names what is made of a run's columns when only
    that is to be kept, besides id, rank, error and lineless: whole records are then neither sorted nor sent.
    """
    runs = without_texts(extract(texts.where(F.length(F.trim("text")) > 0), templates))
    if reader_column in texts.columns:
        runs = _honoured(runs, pinned(templates), reader_column)
    if wanted is not None:
        runs = runs.select(id_column, rank_column, "error", "lineless", *[value.alias(name) for name, value in wanted.items()])
    return best_run(runs, id_column, rank_column)


def waves(texts_of: Callable[[DataFrame, str], DataFrame], docs: DataFrame, templates: Sequence[Template], readers: Sequence[str], id_column: str = "doc_id", pins: bool = True, last_resorts: Sequence[str] = ()) -> DataFrame:
    """Readers one after another, each only on documents that none before it solved with lines.

    ``texts_of(docs, reader)`` gives the id and ``text`` (and ``boxes``, if the reader has them). Each
    wave is written below the shared folder before the next begins, so a reader sees a document once.
    A document whose template names another reader is read again by that one, whose run takes the
    place of the first if it matches; ``pins`` False takes all at face value. ``last_resorts`` are
    readers for documents that have no complete run at all then. A document that no reader gets a
    text of has a row with the error no_text. Ids must not repeat.
    """
    folder = Staging(docs.sparkSession, "waves")
    wanted = pinned(templates) if pins else {}
    left, done = docs, []

    def one(docs: DataFrame, reader: str, rank: int, name: str) -> DataFrame:
        texts = texts_of(docs, reader).where(F.length(F.trim("text")) > 0)
        runs = without_texts(extract(texts, templates)).withColumns({"reader": F.lit(reader), "reader_rank": F.lit(rank)})
        return folder.table(runs, name)

    for rank, reader in enumerate(readers):
        runs = one(left, reader, rank, f"wave{rank}")
        for name in sorted(set(wanted.values()) - {reader}):
            off = runs.where(F.col("template_name").isin([t for t, r in wanted.items() if r == name])).select(id_column)
            if off.isEmpty():
                continue
            again = one(docs.join(off, id_column, "left_semi"), name, rank, f"wave{rank}-{name}").where("template_name is not null")
            again = folder.table(again, f"wave{rank}-{name}-matched")
            runs = runs.join(again.select(id_column), id_column, "left_anti").unionByName(again)
        done.append(runs)
        left = left.join(runs.where("error is null and not lineless").select(id_column), id_column, "left_anti")
    every = reduce(DataFrame.unionByName, done)
    for rank, reader in enumerate(last_resorts, len(readers)):
        solved = every.where("error is null").select(id_column)
        every = every.unionByName(one(docs.join(solved, id_column, "left_anti"), reader, rank, f"resort{rank}"))
    best = best_run(every, id_column)
    none = docs.select(id_column).join(best.select(id_column), id_column, "left_anti").withColumn("error", F.lit("no_text"))
    return best.unionByName(none, allowMissingColumns=True)
