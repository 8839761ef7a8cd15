"""Which template a document goes by."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.regex_dialect import translate
from tabulon.sources.templates import Template, by_priority

#: From this many keywords on, one automaton pass over a text beats a search for each.
MANY_KEYWORDS = 400


def matches(text: Column, template: Template) -> Column:
    """All keywords occur in the text and no excluded one does; keywords are literal unless the template says otherwise."""
    has = (lambda k: text.rlike(translate(k).java)) if template.keyword_mode == "regex" else text.contains
    wanted = reduce(Column.__and__, [has(k) for k in template.keywords])
    return reduce(Column.__and__, [~has(k) for k in template.exclude], wanted)


def first_match(text: Column, templates: Sequence[Template]) -> Column:
    """Index (by the given order) of the matching template of highest priority, the first among equals; else null.

    One conditional expression: no join and no shuffle, and a text stops at its template.
    """
    index = {id(t): k for k, t in enumerate(templates)}
    out = None
    for t in by_priority(templates):
        out = F.when(matches(text, t), index[id(t)]) if out is None else out.when(matches(text, t), index[id(t)])
    return out if out is not None else F.lit(None).cast("int")


def _automaton_match(docs: DataFrame, templates: Sequence[Template], text_column: str) -> DataFrame:
    order = by_priority(templates)
    index = {id(t): k for k, t in enumerate(templates)}
    words = sorted({k for t in templates for k in (*t.keywords, *t.exclude)})
    number = {w: k for k, w in enumerate(words)}
    rules = [(index[id(t)], [number[k] for k in t.keywords], [number[k] for k in t.exclude]) for t in order]
    schema = T.StructType([*docs.schema.fields, T.StructField("template_index", T.IntegerType())])
    at = docs.columns.index(text_column)

    def find(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w, k in number.items():
            machine.add_word(w, k)
        machine.make_automaton()
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                hits = {k for _, k in machine.iter(text)} if text else set()
                out.append(next((i for i, want, veto in rules if all(k in hits for k in want) and not any(k in hits for k in veto)), None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=schema.names)

    return docs.mapInArrow(find, schema)


def match(docs: DataFrame, templates: Sequence[Template], text_column: str = "text") -> DataFrame:
    """Adds ``template_index``: which of ``templates`` each document goes by, null for none."""
    keywords = sum(len(t.keywords) + len(t.exclude) for t in templates)
    literal = all(t.keyword_mode == "literal" and all(t.keywords) for t in templates)
    if keywords >= MANY_KEYWORDS and literal:
        return _automaton_match(docs, templates, text_column)
    return docs.withColumn("template_index", first_match(F.col(text_column), templates))


def all_matches(docs: DataFrame, templates: Sequence[Template], text_column: str = "text") -> DataFrame:
    """A row for every document and template that match, with ``template_name`` and ``priority``."""
    found = F.array_compact(F.array(*[F.when(matches(F.col(text_column), t), F.struct(F.lit(t.name).alias("template_name"), F.lit(t.priority).alias("priority"))) for t in templates]))
    return docs.withColumn("found", F.explode(found)).select("*", "found.*").drop("found")
