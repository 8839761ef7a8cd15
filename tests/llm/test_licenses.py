import random
import re
from collections import Counter

import pyarrow as pa

from tabulon.llm import kernels as K
from tabulon.llm import licenses


def brute(rows, templates, percent):
    bag = lambda t: set(re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    out = Counter()
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n"), 1):
            have = bag(line)
            for name, t in templates.items():
                want = bag(t)
                n = len(have & want)
                if n and 100 * n >= percent * len(want):
                    out[i, k, name, n, len(want)] += 1
    return out


def test_oracle(spark, sf_dir, duck):
    got = Counter(tuple(r) for r in licenses.op10_licenses(spark, sf_dir).select("doc_id", "block", "license", "overlap", "template_tokens").collect())
    assert got == Counter(map(tuple, duck.execute(licenses.oracle()).fetchall()))


def test_brute_force_on_dense_overlaps(spark):
    r = random.Random(1)
    stock = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "Qr", "ST"]
    templates = {f"t{k}": " ".join(r.choices(stock, k=r.randint(1, 7))) for k in range(12)} | {"none": "!!"}
    rows = [(k % 50, "\n".join(" ".join(r.choices([*stock, "zz", "é"], k=r.randint(0, 9))) for _ in range(r.randint(0, 6)))) for k in range(200)]
    rows += [(None, "ab cd\n\n\nef"), (7, None), (8, ""), (9, "\n"), (9, "\n"), (10, "no licence")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for percent in (1, 50, 80, 100):
        got = Counter(map(tuple, licenses.scan(docs, templates, percent).collect()))
        assert got == brute(rows, templates, percent)


def test_awkward(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    templates = {"a": "line", "b": "x", "c": "more ll end we"}
    assert Counter(map(tuple, licenses.scan(awkward, templates, 60).collect())) == brute(rows, templates, 60)
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(awkward, {}).count() == 0


def test_blocks_are_lines():
    texts = ["a\nb", "", "\n", "c\n", "d"]
    _, block, row, number = licenses._blocks(K.strings(pa.array(texts)))
    assert list(zip(row.tolist(), number.tolist())) == [(i, k) for i, t in enumerate(texts) for k in range(1, len(t.split("\n")) + 1)]
    assert [(row[b], number[b]) for b in block] == [(0, 1), (0, 2), (3, 1), (4, 1)]


def test_notice_lines_of_the_documents(spark, sf_dir, documents):
    """Lines that name a license or rights, found in the documents by these words and not by the templates."""
    short = {"apache": "apache-2.0-short", "mit": "mit-short", "general public": "gpl-3.0-short", "by-nc": "cc-by-nc-4.0-short", "all rights": "all-rights-reserved-short"}
    want = set()
    for i, text in documents.select("doc_id", "text").collect():
        for k, line in enumerate((text or "").split("\n"), 1):
            if re.search(r"\blicen[sc]ed?\b|rights reserved|copyright|public domain", line, re.I):
                want.add((i, k, next(name for part, name in short.items() if part in line.lower())))
    got = {(r.doc_id, r.block, r.license) for r in licenses.op10_licenses(spark, sf_dir).collect()}
    assert {"mit-short", "all-rights-reserved-short"} <= {name for _, _, name in want}
    assert {x for x in got if x[2].endswith("-short")} == want


def test_short_forms_tell_licenses_apart(spark):
    lines = {
        "Released under the MIT License.": {"mit-short"},
        "Released under the Zlib License.": set(),
        "All rights are theirs.": set(),
        "Distributed under the Mozilla Public License 2.0": {"mpl-2.0-short"},
        "Licensed under the GNU General Public License, version 3": {"gpl-3.0-short"},
        "Licensed under the GNU General Public License, version 2": set(),
        "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause-short"},
        "Shared under CC BY-SA 4.0": {"cc-by-sa-4.0-short"},
    }
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = [set() for _ in lines]
    for r in licenses.scan(docs).collect():
        got[r.doc_id].add(r.license)
    assert got == list(lines.values())


def brute_runs(rows, templates, percent):
    bag = lambda t: re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    out = Counter()
    for i, text in rows:
        lines = [set(bag(line)) for line in (text or "").split("\n")]
        for name, t in templates.items():
            want = set(bag(t))
            enough = lambda a, b: bool(want) and 100 * len(want & set().union(*lines[a:b])) >= percent * len(want)
            for a in range(len(lines)) if 100 * (len(want) - 1) >= percent * len(want) else ():
                for b in range(a + 2, min(len(lines), a + len(bag(t))) + 1):
                    if all(lines[a:b]) and enough(a, b) and not enough(a + 1, b) and not enough(a, b - 1):
                        out[i, a + 1, name, len(want & set().union(*lines[a:b])), len(want)] += 1
    return out


def test_brute_force_on_wrapped(spark):
    r = random.Random(2)
    stock = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "Qr", "ST"]
    templates = {f"t{k}": " ".join(r.choices(stock, k=r.randint(1, 9))) for k in range(12)} | {"none": "!!"}
    rows = [(k % 50, "\n".join(" ".join(r.choices([*stock, "zz", "é"], k=r.randint(0, 4))) for _ in range(r.randint(0, 12)))) for k in range(200)]
    rows += [(None, "ab cd\n# ef\n\nef"), (7, None), (8, ""), (9, "\n"), (9, "\n"), (10, "no licence")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for percent in (50, 80, 100):
        got = Counter(map(tuple, licenses.scan(docs, templates, percent, wrapped=True).collect()))
        runs = brute_runs(rows, templates, percent)
        assert bool(runs) == (percent < 100) and got == brute(rows, templates, percent) + runs


def test_wrapped_notices(spark, tmp_path):
    import textwrap

    names = [n for n in licenses.TEMPLATES if len(licenses.tokens(licenses.TEMPLATES[n])) > 4]
    cases = [(name, width, mark) for name in names for width in (20, 40, 60, 72, 80, 100, 120) for mark in ("", "# ", " * ")]
    texts = ["Some prose before.\n" + "\n".join(mark + line for line in textwrap.wrap(licenses.TEMPLATES[name], width)) + "\n\nAnd after." for name, width, mark in cases]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.license) for r in licenses.op10_licenses(spark, str(tmp_path)).collect()}
    assert not [case for k, case in enumerate(cases) if (k, case[0]) not in found]
