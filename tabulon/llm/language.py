"""Operator 2: language identification by compression with per-language dictionaries."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import kernels as K
from tabulon.llm import shared

#: Labelled rows per language, and bytes of each: longer rows aren't fitted on. The bounds of what is fitted.
ROWS, ROW_BYTES = 60, 8 << 10
#: A text is coded in blocks of this size, so that a long text's later parts see the dictionary too.
BLOCK = 4096
#: Follows every block and is taken off its size again: below some bytes the coder stores all as it is, whatever the dictionary.
FILLER = b"\x01" * 64
#: The best code must be smaller than the second by this share of it.
MARGIN = 0.03


def letters(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Lower-cased runs of letters with one blank between; signs and digits say nothing of language."""
    text = pc.utf8_lower(K.strings(column))
    return pc.utf8_trim(pc.replace_substring_regex(text, r"[^\p{L}]+", " "), " ")


def content(texts: list[str]) -> bytes:
    """The texts' letters one after another; a line that a text repeats is taken once."""
    lines = [line for text in texts for line in dict.fromkeys(text.split("\n"))]
    return " ".join(filter(None, letters(pa.array(lines, pa.string())).to_pylist())).encode()


def fit(docs: DataFrame, rows: int = ROWS, row_bytes: int = ROW_BYTES, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary for each label: the whole texts of ``rows`` labelled rows that a hash of id and text puts first.

    Rows of over ``row_bytes`` bytes aren't fitted on, so at most rows * row_bytes a label reach the
    driver, whatever the input. Rows without label, id or text are left out, repeated ones count
    once. A label without rows of that size, or letters in them, has no dictionary.
    """
    source = docs.select(docs[id_column].alias("id"), docs[label_column].alias("label"), docs[text_column].alias("text"))
    known = source.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.octet_length("text") <= row_bytes)).withColumn("of", F.xxhash64("text"))
    first = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "of")
    chosen = known.select("id", "label", "of").distinct().withColumn("at", F.row_number().over(first)).where(F.col("at") <= rows)
    # The chosen rows are at most ``rows`` for each label, whatever the input.
    found = known.join(F.broadcast(chosen), ["id", "label", "of"]).select("label", "at", "text").distinct().toArrow()
    found = found.sort_by([("label", "ascending"), ("at", "ascending"), ("text", "ascending")])
    texts: dict[str, list[str]] = {}
    for label, text in zip(found["label"].to_pylist(), found["text"].to_pylist()):
        texts.setdefault(label, []).append(text)
    return {label: dictionary for label, own in texts.items() if (dictionary := content(own))}


class Classifier:
    """Short matches tell languages apart, so the coder looks for them from three bytes on."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as z

        how = z.ZstdCompressionParameters(window_log=20, chain_log=16, hash_log=16, search_log=4, min_match=3, target_length=32, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.labels = sorted(dictionaries)
        self._code, self._filler = [], []
        for label in self.labels:
            content = z.ZstdCompressionDict(dictionaries[label], dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=how)
            self._code.append(z.ZstdCompressor(dict_data=content, compression_params=how).compress)
            self._filler.append(len(self._code[-1](FILLER)))

    def sizes(self, text: bytes) -> list[int]:
        """Size of the whole text's code by each dictionary, in the labels' order: of all blocks, each less its filler's."""
        blocks = [text[i : i + BLOCK] + FILLER for i in range(0, len(text), BLOCK)]
        return [sum(len(code(block)) for block in blocks) - own * len(blocks) for code, own in zip(self._code, self._filler)]


@lru_cache(maxsize=2)
def _classifier(pickled: bytes) -> Classifier:
    return Classifier(pickle.loads(pickled))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``detected_lang``, ``code_size``, ``second_size`` and ``accepted`` to every row.

    The detected language is that of the smallest code over the whole text, of equal ones the first
    by name. One rule holds for texts of every size. ``accepted`` says that it is smaller than the second by ``margin`` of the second. With
    one dictionary only there is no second and every text with letters is accepted; a text without
    letters (null, empty, signs) or no dictionary at all gives null and is not accepted. Columns of
    ``docs`` with these four names are replaced; ``keep`` limits the others that are carried.
    Repeated rows are judged each; a text is held in memory whole, several times its size.
    """
    added = [("detected_lang", T.StringType()), ("code_size", T.LongType()), ("second_size", T.LongType()), ("accepted", T.BooleanType())]
    kept = [c for c in keep or docs.columns if c not in {name for name, _ in added}]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(*x) for x in added])
    pickled = pickle.dumps(dictionaries)
    source = shared.numbered(docs.select(*[docs[c] for c in kept], docs[text_column]))[0]

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _classifier(pickled)
        for batch in batches:
            label, best, second, accepted = [], [], [], []
            parts = K.slices(K.strings(batch.column(batch.num_columns - 1)))
            for text in (text for part in parts for text in letters(part).to_pylist()):
                sizes = model.sizes(text.encode()) if text else []
                order = np.argsort(sizes, kind="stable")
                a = sizes[order[0]] if sizes else None
                b = sizes[order[1]] if len(sizes) > 1 else None
                label.append(model.labels[order[0]] if sizes else None)
                best.append(a)
                second.append(b)
                accepted.append(a is not None and (b is None or b - a >= margin * b))
            out = [pa.array(label, pa.string()), pa.array(best, pa.int64()), pa.array(second, pa.int64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=schema.names)

    return source.mapInArrow(classify, schema)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is clear, with the columns they came with.

    Null and empty texts, and such without letters, go. Repeated rows all stay or all go. An empty
    table, or one without labels, gives no rows.
    """
    plain, names = shared.numbered(docs)
    found = identify(plain, fit(docs), text_column=names["text"])
    return found.where("accepted").select(*plain.columns).toDF(*docs.columns)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by dictionaries of its own labelled rows; nulls and ties as :func:`identify` says."""
    docs = shared.load(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), fit(docs), keep=["doc_id"])
