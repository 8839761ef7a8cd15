"""Documents to packed training sequences: language, quality, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import language, packing, quality, shared, simhash


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; documents whose language isn't clear go, those without letters (null, empty, signs) among them.

    Repeated rows all stay or all go. Without labelled rows no language is known and nothing stays.
    """
    return language.keep_identified(spark, docs, sf_dir)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5; documents that a learned rule rejects go.

    Null and empty texts, which the first stage has dropped, would be judged by statistics of zero.
    Repeated rows all stay or all go. Without labels of both kinds everything stays.
    """
    return quality.keep_good(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6; one document of each group stays: the one of the least id, null ids last.

    Of repeated rows, and of rows that share id and text, one stays. Texts without words stay.
    """
    return simhash.keep_one(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; every document's place in the training sequences, one row for each piece of at most a sequence's length.

    Of equal lengths the smaller id comes first, null ids last. A text without tokens has a row without place.
    """
    return packing.pack(spark, docs)


STAGES = [("language", clear_language), ("quality", good_quality), ("near_duplicates", near_duplicates), ("packing", packed)]

#: SQL can express neither compression nor learned rules; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written and read again as the next one's input.

    What a stage has written for itself, and the result before it, go when its own result is written.
    An empty table gives no rows; nulls, ties and repeated rows are each stage's, as stated there.
    Columns beside those of documents are carried up to the last stage.
    """
    work = shared.Workspace(spark, "pipeline")
    docs, before = shared.load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with shared.closing():
            docs = work.table(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
