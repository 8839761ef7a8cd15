"""Operator 10: license notices by an exact set-similarity join with text blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import kernels as K
from tabulon.llm import shared

#: Share of a template's distinct tokens that a block must contain, in hundredths.
PERCENT = 80

TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "Copyright. All rights reserved.",
    # One-line forms, of four distinct tokens at most: of so few all are needed, so that 'under the ... License' alone is no hit.
    "apache-2.0-short": "Apache License 2.0",
    "gpl-3.0-short": "General Public License 3",
    "cc-by-nc-4.0-short": "BY-NC 4.0",
    "cc-by-sa-4.0-short": "BY-SA 4.0",
    "mit-short": "The MIT License",
    "bsd-3-clause-short": "BSD 3-Clause",
    "mpl-2.0-short": "Mozilla License 2.0",
    "unlicense-short": "Under the Unlicense",
    "all-rights-reserved-short": "All rights reserved.",
}

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _blocks(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and block of every token of a slice; row and number (from 1) of every block, a line."""
    data, offsets = K.utf8(column)
    data = _LOWER[data]
    cut = np.flatnonzero(data == 10)
    lines = 1 + np.bincount(np.searchsorted(offsets, cut, side="right") - 1, minlength=len(column)) if len(cut) else np.ones(len(column), np.int64)
    row = np.repeat(np.arange(len(column)), lines)
    number = np.arange(len(row)) - np.repeat(np.cumsum(lines) - lines, lines) + 1
    starts, ends, of = K.words(data, offsets, _TOKEN)
    before = np.searchsorted(cut, starts)  # line ends before each token, over all rows
    return K.span_hashes(data, starts, ends), before + of, row, number


@dataclass(frozen=True)
class Template:
    name: str
    tokens: tuple[int, ...]
    least: int
    words: int


def words(text: str) -> np.ndarray:
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = K.words(data, np.array([0, len(data)]), _TOKEN)
    return K.span_hashes(data, starts, ends)


def tokens(text: str) -> np.ndarray:
    return np.unique(words(text))


class Index:
    """Templates with tokens in one global order, rarest first, and their prefixes' postings."""

    def __init__(self, templates: dict[str, str], percent: int, frequency: dict[int, int]) -> None:
        self.vocabulary = np.unique(np.concatenate([tokens(t) for t in templates.values()] or [np.zeros(0, np.uint64)]))
        counts = np.array([frequency.get(k, 0) for k in range(len(self.vocabulary))], np.int64)
        order = np.lexsort((self.vocabulary, counts))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.templates, self.postings = [], {}
        for name, text in sorted(templates.items()):
            ranks = np.sort(self.rank[np.searchsorted(self.vocabulary, tokens(text))])
            if not len(ranks):
                continue
            least = max(1, ceil(len(ranks) * percent / 100))
            for place, rank in enumerate(ranks[: len(ranks) - least + 1].tolist()):
                self.postings.setdefault(rank, []).append((len(self.templates), place))
            self.templates.append(Template(name, tuple(ranks.tolist()), least, len(words(text))))
        self.starts = np.zeros(len(order) + 1, bool)
        self.starts[list(self.postings)] = True

    def find(self, ranks: list[int]) -> list[tuple[Template, int]]:
        """Templates that a block with these ascending ranks contains enough of, with the overlap."""
        met: dict[int, bool] = {}
        size = len(ranks)
        for j, rank in enumerate(ranks):
            for k, place in self.postings.get(rank, ()):
                template = self.templates[k]
                if k not in met and size >= template.least:  # length
                    rest = 1 + min(len(template.tokens) - place - 1, size - j - 1)  # position of the first common token
                    met[k] = rest >= template.least
        inside = set(ranks)
        found = [(self.templates[k], sum(t in inside for t in self.templates[k].tokens)) for k, may in met.items() if may]
        return [(t, n) for t, n in found if n >= t.least]


def runs(template: Template, lines: list[tuple[int, set[int]]], blank: set[int]) -> list[tuple[int, int]]:
    """First line and overlap of every run of two lines and more that contains enough of the template and holds no shorter one.

    ``lines`` are the numbers and ranks of the lines with tokens of any template, ascending. A run
    has no line of ``blank`` and not more lines than the template has words. A template of so few
    tokens that all are needed is not searched for: prose next to another notice makes it up ('License' and German 'mit').
    """
    if template.least == len(template.tokens):
        return []
    want, count, found, i = set(template.tokens), dict.fromkeys(template.tokens, 0), [], 0
    lines = [(n, common) for n, ranks in lines if (common := ranks & want)]
    have = 0
    for n, common in lines:
        for t in common:
            have += not count[t]
            count[t] += 1
        if have < template.least:
            continue
        while have >= template.least:  # the last line whose loss leaves too little is the run's first
            first, overlap = i, have
            for t in lines[i][1]:
                count[t] -= 1
                have -= not count[t]
            i += 1
        start = lines[first][0]
        if start < n < start + template.words and blank.isdisjoint(range(start, n)):
            found.append((start, overlap))
    return found


def _known(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (block, token number) of the tokens in the vocabulary, the blocks' rows and numbers, and which have any token."""
    h, block, row, number = _blocks(column)
    at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
    hit = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
    both = np.unique(block[hit] * len(vocabulary) + at[hit]) if hit.any() else np.zeros(0, np.int64)
    filled = np.zeros(len(row), bool)
    filled[block] = True
    return both // max(1, len(vocabulary)), both % max(1, len(vocabulary)), row, number, filled


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text", wrapped: bool = False) -> DataFrame:
    """Every block (line) of every text that contains ``percent`` hundredths of a template's tokens.

    Tokens are the distinct runs of ASCII letters and digits, without regard to ASCII case. A first
    pass counts the blocks with each token of any template over all texts; ordered by this, rarest
    first, a block that contains enough shares a token of the template's prefix, and the length and
    position filters drop no such block. Tokens in no template cannot add to an overlap and are left
    out of a block's set.

    ``wrapped`` also finds notices that are wrapped over lines: runs of adjacent lines, none without
    a token and not more than the template has words, that together contain enough while no shorter
    run in them does; templates of which every token is needed are looked for in single lines only. Only texts that contain enough as a whole, by the same filters, are searched.

    Result: the id column, ``block`` (line number from 1, of a run its first), ``license``, ``overlap`` and
    ``template_tokens``; a row for each block and template, repeated for repeated rows and with null
    ids kept. Null and empty texts have no tokens. Other columns are ignored; a template without
    tokens matches nothing.
    """
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema[id_column].dataType
    source = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    vocabulary = Index(templates, percent, {}).vocabulary

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in K.slices(K.strings(batch.column(0))):
                total += np.bincount(_known(part, vocabulary)[1], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["token", "n"])

    # A row per token of the templates.
    counted = source.select("text").mapInArrow(frequency, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    index = Index(templates, percent, {r.token: r.n for r in counted})
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("block", T.LongType()), T.StructField("license", T.StringType()), T.StructField("overlap", T.IntegerType()), T.StructField("template_tokens", T.IntegerType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = 0
            for part in K.slices(K.strings(batch.column(1))):
                block, token, row, number, filled = _known(part, vocabulary)
                rank = index.rank[token] if len(token) else token
                out: list[tuple] = []
                if wrapped and len(token):
                    whole = np.unique(row[block] * len(vocabulary) + rank)
                    text, of = whole // len(vocabulary), whole % len(vocabulary)
                    for r in np.unique(text[index.starts[of]]).tolist():
                        at, to = np.searchsorted(text, [r, r + 1])
                        hits = index.find(of[at:to].tolist())
                        if not hits:
                            continue
                        a, b = np.searchsorted(row, [r, r + 1])  # its lines
                        of_line: dict[int, set[int]] = {}
                        for n, k in zip(number[block[(i := np.searchsorted(block, a)) : (j := np.searchsorted(block, b))]].tolist(), rank[i:j].tolist()):
                            of_line.setdefault(n, set()).add(k)
                        blank = set(number[a:b][~filled[a:b]].tolist())
                        for t, _ in hits:
                            out += [(before + r, first, t.name, n, len(t.tokens)) for first, n in runs(t, list(of_line.items()), blank)]
                may = np.unique(block[index.starts[rank]]) if len(token) else block
                keep = np.isin(block, may)
                block, rank = block[keep], rank[keep]
                order = np.lexsort((rank, block))
                block, rank = block[order], rank[order]
                first = np.searchsorted(block, may)
                for b, ranks in zip(may.tolist(), np.split(rank, first[1:])):
                    out += [(before + row[b], number[b], t.name, n, len(t.tokens)) for t, n in index.find(ranks.tolist())]
                if out:
                    at, numbers, names, overlaps, sizes = zip(*out)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int64()), pa.array(names), pa.array(overlaps, pa.int32()), pa.array(sizes, pa.int32())], names=schema.names)
                before += len(part)

    return source.mapInArrow(join, schema)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.load(spark, sf_dir, "documents"), wrapped=True)


def oracle(templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in templates.items())
    bag = "list_distinct(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'))"
    return f"""
WITH templates AS (SELECT license, {bag.format("text")} AS want FROM (VALUES {rows}) AS t(license, text)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS block FROM documents),
blocks AS (SELECT doc_id, block, {bag.format("line")} AS have FROM lines),
pairs AS (SELECT doc_id, block, license, len(list_intersect(have, want)) AS overlap, len(want) AS template_tokens FROM blocks, templates)
SELECT doc_id, block, license, CAST(overlap AS INTEGER) AS overlap, CAST(template_tokens AS INTEGER) AS template_tokens
FROM pairs WHERE overlap >= 1 AND overlap * 100 >= template_tokens * {percent}"""
