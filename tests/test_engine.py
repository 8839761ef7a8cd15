import json
import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import cascade, lines, matching, python_dialect, tables, wordboxes
from tabulon.plans.engine import extract, extract_wide
from tabulon.sources.templates import Template, TemplateError, make_template, named, parse_templates, read_templates


def lines_template(**settings):
    return make_template({"keywords": "k", "fields": {"lines": {"parser": "lines", **settings}}})


def native_rows(spark, template, texts):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    made = lines.line_items(F.col("t"), template.fields[0], template.options)
    return [[{k: v for k, v in r.asDict().items() if v is not None} for r in row.x] for row in frame.select("k", made.alias("x")).orderBy("k").collect()]


PIECES = ["S\n", "E\n", "F 1\n", "F 2 x\n", "L a\n", "L\n", "Z 9\n", "skip F 3\n", "\n", "  \n", "\r\n", "noise\n", "SE", "L  b \n"]
CASES = [
    {"start": "S", "end": "E", "line": r"L\s*(?P<a>\w?)"},
    {"start": "S", "end": "E", "end_match": "last", "line": [r"F (?P<n>\d)(?P<x> x)?", r"L\s*(?P<a>\w?)"], "skip_line": "^skip"},
    {"start": "S+", "end": "E+", "first_line": r"F (?P<n>\d)", "line": r"L\s*(?P<a>\w?)"},
    {"start": "S", "end": "E", "first_line": r"F (?P<n>\d)", "line": r"L\s*(?P<a>\w?)", "last_line": r"Z (?P<a>\d)", "skip_line": ["^skip", "noise"]},
    {"start": "S", "end": "E", "line": "(?P<a>L)", "last_line": "(?P<b>Z)"},
    {"rules": [{"start": "S", "end": "E", "line": r"(?P<n>\d)", "types": {"n": "int"}}, {"start": "S", "end": "E", "line": "(?P<a>L)", "replace": {"a": ["L", "l"]}}]},
]


@pytest.mark.parametrize("settings", CASES)
def test_lines_equal_the_state_machine(spark, settings):
    r = random.Random(str(settings))
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 25))) for _ in range(400)]
    template = lines_template(**settings)
    assert template.native
    want = [python_dialect.line_items(t, template.fields[0], template.options) for t in texts]
    assert native_rows(spark, template, texts) == want
    assert any(want) or "last_line" in settings


def test_continued_cells(spark):
    template = lines_template(start="S\n", end="E", first_line=r"F(?P<a>.*)", line=r"L(?P<a>.*)")
    assert native_rows(spark, template, ["S\nF x\nL y\nL\nL z\nF\nL q\nE"]) == [[{"a": "x\ny\n\nz"}, {"a": "q"}]]


def test_whitespace_lines_count_in_lines_only(spark):
    template = lines_template(start="S\n", end="E", line=r"^(?P<a>\s*)$")
    assert native_rows(spark, template, ["S\n  \n\nx\nE"]) == [[{"a": ""}]]


def test_tables(spark):
    rule = {"start": "S", "end": "E", "body": r"(?P<date>\S+) (?P<amount>[\d.]+)(?P<note> n)?"}
    made = make_template({"keywords": "k", "tables": [rule]})
    texts = ["S\n2024-01-02 1.5\n   \n2024-01-03 2 n\nbad\nE 9", "E S\n2024-01-02 1\n", "nothing", "S 2024-01-02 3\nE"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = tables.columns(F.col("t"), made.tables[0], made.options)
    got = [r.asDict() for r in frame.select("k", *[v.alias(n) for n, v in found.items()]).orderBy("k").collect()]
    for text, row in zip(texts, got):
        want = python_dialect.table(text, made.tables[0], made.options)
        for name in ("date", "amount", "note"):
            value = want.get(name)
            assert row[name] == (value if isinstance(value, list) or value is None else [value])


TEXT = "Acme GmbH\nInvoice A-7\nDate 03.02.2024\nVAT 21\nnet 1.000,50 EUR\nnet 2,00 EUR\nTotal 1.212,63 EUR\nSTART\n2 kg apples 4,00\n1 furlong rope 6,00\nSTOP\nTAX\n21 % of 10,00\nTAXEND\n"
RAW = {
    "keywords": ["Acme", "Total"], "issuer": "Acme", "options": {"decimal_separator": ",", "date_formats": ["%d.%m.%Y"]},
    "fields": {
        "invoice_number": r"Invoice (\S+)", "date": r"Date (\S+)", "amount": r"Total ([\d.,]+)", "amount_untaxed": {"parser": "regex", "regex": r"net ([\d.,]+)", "type": "float", "group": "sum"},
        "refs": {"parser": "regex", "regex": [r"(net)", r"(Invoice)"]}, "static_vat": 7740001454, "absent": "nope (x)", "pair": "(a)(b)",
        "lines": {"parser": "lines", "start": "START\n", "end": "STOP", "line": r"(?P<qty>\d+) (?P<uom>\S+) (?P<description>.+) (?P<price_subtotal>[\d.,]+)", "types": {"qty": "int", "price_subtotal": "float"}},
        "tax_lines": {"parser": "lines", "start": "TAX\n", "end": "TAXEND", "line": r"(?P<vat_rate>\d+) % of (?P<price_subtotal>[\d.,]+)", "types": {"vat_rate": "float", "price_subtotal": "float"}},
    },
}


def record(spark, template, text, **options):
    frame = spark.createDataFrame([(1, text)], "doc_id int, text string")
    row = extract(frame, [template]).withColumn("record", F.to_json("record")).first()
    return row, json.loads(row.record) if row.record else None


def test_whole_record(spark):
    row, made = record(spark, make_template(RAW, "acme.yml"), TEXT)
    assert row.error is None and not row.lineless and list(row.unknown) == ["refs"]
    assert made["issuer"] == "Acme" and made["template_name"] == "acme.yml" and made["desc"] == "Invoice from Acme" and made["currency"] == "EUR"
    assert made["invoice_number"] == "A-7" and made["date"].startswith("2024-02-03") and made["amount"] == 1212.63 and made["amount_untaxed"] == 1002.5
    assert made["refs"] == ["net", "Invoice"] and made["vat"] == 7740001454 and "absent" not in made and "pair" not in made
    a, b = made["lines"]
    assert (a["name"], a["qty"], a["unece_code"], a["line_tax_percent"], a["line_tax_amount"]) == ("apples", 2, "KGM", 21, 0.84)
    assert b["name"] == "rope" and b.get("unece_code") is None and b["line_tax_amount"] == 1.26
    assert made["tax_lines"][0] == {"line_tax_percent": 21, "price_subtotal": 10, "line_tax_amount": 2.1}


def test_errors(spark):
    bad = make_template({**RAW, "fields": {**RAW["fields"], "amount": r"(Invoice)"}}, "bad")
    assert record(spark, bad, TEXT)[0].error == "number"
    lacking = make_template({**RAW, "required_fields": ["iban", "issuer"]}, "lacking")
    row, made = record(spark, lacking, TEXT)
    assert (row.error, list(row.missing), made) == ("missing", ["iban"], None)
    strict = make_template({**RAW, "options": {**RAW["options"], "strict_fields": True}}, "strict")
    assert record(spark, strict, TEXT)[0].error == "strict_fields"
    allowed = make_template({**RAW, "options": {**RAW["options"], "strict_fields": True, "extra_fields": ["refs", "pair"]}}, "allowed")
    assert record(spark, allowed, TEXT)[0].error is None
    assert record(spark, make_template(RAW), "other")[0].error == "no_template"
    assert record(spark, make_template(RAW), None)[0].error == "no_template"


def test_python_patterns_take_the_python_way(spark):
    raw = {**RAW, "fields": {**RAW["fields"], "twice": {"parser": "regex", "regex": r"(p)\1"}}}
    template = make_template(raw, "python")
    assert not template.native
    row, made = record(spark, template, TEXT)
    assert row.error is None and made["invoice_number"] == "A-7" and made["amount"] == 1212.63 and made["twice"] == "p" and len(made["lines"]) == 2


def test_accents_are_off_before_patterns_see_the_text(spark):
    raw = {"keywords": "é", "required_fields": ["issuer"], "options": {"remove_accents": True, "lowercase": True, "remove_whitespace": True}, "fields": {"x": r"(cafe\d)", "lines": {"parser": "lines", "start": "cafe", "end": "$", "line": r"(?P<a>\d)"}}}
    template = make_template(raw, "accents")
    frame = spark.createDataFrame([(1, "CAF É1"), (2, "café 2"), (3, None), (4, "x")], "doc_id int, text string")
    got = {r.doc_id: json.loads(r.record)["x"] for r in extract(frame, [template]).withColumn("record", F.to_json("record")).where("record is not null").collect()}
    assert got == {2: "cafe2"}
    assert [(r.doc_id, r.x, r.lines[0].a) for r in extract_wide(frame, template).collect()] == [(2, "cafe2", "2")]


def test_wide_and_empty(spark):
    template = make_template(RAW, "acme.yml")
    frame = spark.createDataFrame([(1, TEXT, "kept"), (2, "no", "x"), (3, None, None)], "doc_id int, text string, missing_ string")
    rows = extract_wide(frame, template).collect()
    assert len(rows) == 1 and rows[0].amount == 1212.63 and rows[0].refs is None and list(rows[0].refs_all) == ["net", "Invoice"]
    assert extract_wide(frame.where("1=0"), template).count() == 0 == extract(frame.where("1=0"), [template]).count()


def test_priority_and_exclusion(spark):
    every = [make_template({"template_name": n, "keywords": k, "priority": p, "exclude_keywords": x}) for n, k, p, x in (("a", "k", 5, []), ("b", "k", 9, ["no"]), ("c", ["k", "z"], 9, []), ("d", "k", 5, []))]
    frame = spark.createDataFrame([(t,) for t in ("k", "k no", "k no z", "x", None)], "text string")
    want = {"k": 1, "k no": 0, "k no z": 2, "x": None, None: None}
    assert {r.text: r.template_index for r in matching.match(frame, every).collect()} == want
    assert {r.text: r.template_index for r in matching._automaton_match(frame, every, "text").collect()} == want
    pattern = make_template({"keywords": "^k.z$", "keyword_mode": "regex"})
    assert spark.createDataFrame([("k-z",), ("kz",)], "text string").where(matching.matches(F.col("text"), pattern)).count() == 1


def without_lists():
    """A list of any field counts as lines, so these have none."""
    return {**RAW, "fields": {k: v for k, v in RAW["fields"].items() if k != "refs"}}


def test_cascade_prefers_runs_with_lines(spark):
    template = make_template(without_lists(), "acme.yml")
    bare = TEXT.replace("START", "").replace("TAX\n", "")
    runs = spark.createDataFrame([(1, 0, "quick", bare), (1, 1, "slow", TEXT), (2, 0, "quick", bare), (2, 1, "slow", "junk"), (3, 0, "quick", "junk"), (3, 1, "slow", " ")], "doc_id int, reader_rank int, reader string, text string")
    best = {r.doc_id: (r.reader_rank, r.error) for r in cascade.cascade(runs, [template]).collect()}
    assert best == {1: (1, None), 2: (0, None), 3: (0, "no_template")}
    pinned = make_template({**without_lists(), "input_module": "slow"}, "acme.yml")
    assert {r.doc_id: r.reader_rank for r in cascade.cascade(runs.where("doc_id = 2 or doc_id = 1"), [pinned]).collect() if r.error is None} == {1: 1}


def test_waves_stop_where_lines_are_found(spark):
    template = make_template(RAW, "acme.yml")
    asked = []

    def texts_of(docs, reader):
        asked.append((reader, docs.count()))
        return docs.select("doc_id", F.when((F.col("doc_id") == 1) | (F.lit(reader) == "slow"), TEXT).otherwise("junk").alias("text"))

    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    best = {r.doc_id: r.reader_rank for r in cascade.waves(texts_of, docs, [template], ["quick", "slow"]).collect()}
    assert best == {1: 0, 2: 1} and asked == [("quick", 2), ("slow", 1)]


def test_word_boxes(spark):
    boxes = [(1, 50.0, 11.5, 60.0, 20.0, "b"), (1, 10.0, 10.0, 20.0, 20.0, "a"), (1, 10.0, 30.0, 20.0, 40.0, "c"), (2, 10.0, 10.0, 20.0, 20.0, "d"), (1, 500.0, 10.0, 510.0, 20.0, "far")]
    frame = spark.createDataFrame([(boxes,), ([],)], "b array<struct<page:int,x0:double,y0:double,x1:double,y1:double,text:string>>")
    area = {"f": 1, "l": 2, "r": 144, "x": 0, "y": 0, "W": 300, "H": 300}
    assert [r.x for r in frame.select(wordboxes.crop(F.col("b"), area).alias("x")).collect()] == ["a b\nc\nd", ""]


def test_template_grammar(tmp_path, caplog):
    for raw in (
        {}, {"keywords": "k", "options": {"languages": ["eng"]}}, {"keywords": "k", "fields": {"x": {"parser": "regex"}}}, {"keywords": "k", "fields": {"x": {"parser": "tables"}}},
        {"keywords": "k", "fields": {"x": {"parser": "regex", "regex": "a", "type": "decimal"}}}, {"keywords": "k", "fields": {"x": {"parser": "regex", "regex": "a", "group": "avg"}}},
        {"keywords": "k", "fields": {"x": {"parser": "lines", "start": "a", "end": "b"}}}, {"keywords": "k", "fields": {"x": {"parser": "lines", "start": "a*", "end": "b", "line": "c"}}},
        {"keywords": "k", "tables": [{"start": "a"}]}, {"keywords": "k", "options": {"replace": [["a", "b", "c"]]}}, {"keywords": "k", "fields": {"x": "("}}, {"keywords": "k", "fields": {"x": {"parser": "regex", "regex": "a", "area": {"f": 1}}}},
    ):
        with pytest.raises(TemplateError):
            make_template(raw)
    made = make_template({"keywords": "k", "options": {"languages": "fr"}, "fields": {"x": {"regex": "no parser"}, "sum_amount_x": ["a", "b"], "due_date": "d", "static_y": 1}, "lines": {"start": "a", "end": "b", "line": "c"}})
    assert isinstance(made, Template) and made.issuer == "k" and made.options.languages == ("fr",)
    assert [(f.name, getattr(f, "type", None), getattr(f, "group", None)) for f in made.fields] == [("amount_x", "float", "sum"), ("due_date", "date", None), ("y", None, None), ("lines", None, None)]
    assert [t.name for t in parse_templates(json.dumps([{"template_name": "one", "keywords": "k"}, 3, {}]))] == ["one"] and parse_templates("{}") == []
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "two.json").write_text('{"keywords": "k"}')
    (tmp_path / "a.yml").write_text("keywords: [k]\nfields: {date: 'x'}\n")
    (tmp_path / "bad.yml").write_text("keywords: [\n")
    (tmp_path / "no.txt").write_text("x")
    found = read_templates(tmp_path)
    assert [t.name for t in found] == ["a.yml", "two.json"] and [t.name for t in named(found, "TWO")] == ["two.json"]
    with pytest.raises(ValueError, match="a.yml"):
        named(found, "zzz")
    assert not make_template({"keywords": "k", "fields": {"l": {"parser": "lines", "start": "^S", "end": "E", "line": "(?P<a>x)"}}}).native


def both_ways(spark, template, texts, boxes=None):
    """Rows of the native plan and of the Python dialect, without what is null and with dates as text."""

    def plain(value):
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items() if v is not None}
        return [plain(v) for v in value] if isinstance(value, list) else value

    shape = "doc_id int, text string" + (", boxes array<struct<page:int,x0:double,y0:double,x1:double,y1:double,text:string>>" if boxes else "")
    frame = spark.createDataFrame([(k, t, *([boxes] if boxes else [])) for k, t in enumerate(texts)], shape)
    out = []
    for engine in ("native", "python"):
        rows = extract(frame, [template], engine=engine).withColumn("record", F.to_json("record")).orderBy("doc_id").collect()
        known = lambda r: r.error != "number"  # noqa: E731 - where a number fails, nothing else is promised
        out.append([(r.error, sorted(r.missing or []) if known(r) else [], sorted(r.unknown or []) if known(r) else [], r.lineless if known(r) else None, list(r.warnings or []) if known(r) else [], sorted(r.names or []) if known(r) else [], plain(json.loads(r.record)) if r.record else None) for r in rows])
    return out


ITEM = r"\s*(?P<qty>\d+) (?P<uom>\S+) (?P<description>\w+)(?: (?P<name>[A-Z]\w+))? (?P<unit_price>[\d.x]+) (?P<price_subtotal>[\d.]+)"
ENRICHED = {
    "keywords": "Shop", "issuer": "Shop", "required_fields": ["issuer"], "options": {"languages": ["fr"]},
    "fields": {
        "date": r"Le (.+)", "amount": {"parser": "regex", "regex": r"Total (\S+)", "type": "float"}, "amount_tax": {"parser": "regex", "regex": r"Tax total (\S+)", "type": "float"},
        "lines": {"parser": "lines", "rules": [{"start": "ROWS", "end": "END", "line_separator": r"\n\s*\n|;", "line": [f"^{ITEM} code (?P<line_tax_code>\\w)$", f"{ITEM} at (?P<vat_rate>\\d+)$", f"^{ITEM}$", r"^note (?P<line_note>.+)"], "types": {"qty": "int", "unit_price": "float", "price_subtotal": "float", "vat_rate": "float"}}]},
        "tax_lines": {"parser": "lines", "start": "TAXES", "end": "END", "line": [r"(?P<line_tax_code>\w) (?P<tax_percent>[\d.]+)% of (?P<price_subtotal>[\d.]+)$", r"(?P<line_tax_code>\w) (?P<tax_percent>[\d.]+)% of (?P<price_subtotal>[\d.]+) is (?P<line_tax_amount>[\d.]+)$"], "types": {"tax_percent": "float", "price_subtotal": "float", "line_tax_amount": "float"}},
    },
}


def test_both_engines_give_the_same_records(spark):
    """Aliases, unit codes, tax by code and by the only rate, computed tax, the tax total, separators as patterns, months in French."""
    r = random.Random(12)
    template = make_template(ENRICHED, "shop.yml")
    assert template.native
    texts = []
    for _ in range(150):
        rows = [f"{r.randint(1, 9)} {r.choice(['kg', 'STK.', 'foo'])} thing{r.choice(['', ' Named'])} {r.choice(['1.5', '2', 'x.1'])} {r.randint(1, 900) / 8}{r.choice(['', ' code A', ' code B'])}{r.choice(['', '', ' at 6'])}" for _ in range(r.randint(0, 4))]
        taxes = [f"{c} {p}% of {r.randint(0, 300)}{r.choice(['', ' is 12.5'])}" for c in "AB" for p in r.sample([0, 9, 21], r.randint(0, 2))]
        texts.append(f"Shop\nLe {r.choice(['5 mars 2024', '1er juin 2023', 'hier'])}\nTotal {r.choice(['12.50', 'many', '7'])}\nTax total {r.choice(['3.00', '12.50'])}\nROWS\n" + r.choice(["\n\n", "\n  \n", ";"]).join(rows) + "\nEND\nTAXES\n" + "\n".join(taxes) + "\nEND\n")
    native, python = both_ways(spark, template, [*texts, "Shop", "other", None])
    assert native == python
    made = [x for *_, x in native if x]
    assert len({e for e, *_ in native}) >= 3 and any("tax_total" in w for *_, w, _, _ in native)
    rows = [row for x in made for row in x.get("lines", [])]
    assert {"name", "description", "unece_code", "line_tax_percent", "line_tax_amount", "price_unit"} <= {k for row in rows for k in row}


def test_both_engines_see_areas(spark):
    words = [(1, 10.0, 10.0, 40.0, 20.0, "Total"), (1, 50.0, 11.0, 80.0, 20.0, "12"), (1, 10.0, 300.0, 80.0, 310.0, "Total"), (1, 90.0, 300.0, 95.0, 310.0, "99"), (2, 10.0, 10.0, 20.0, 20.0, "Total")]
    area = {"f": 1, "l": 1, "r": 72, "x": 0, "y": 0, "W": 100, "H": 100}
    template = make_template({"keywords": "k", "issuer": "k", "required_fields": ["issuer"], "fields": {"total": {"parser": "regex", "regex": r"Total (\d+)", "area": area}}})
    native, python = both_ways(spark, template, ["k Total 99"], words)
    assert native == python and native[0][-1]["total"] == "12"


def test_the_python_way_takes_no_field_from_a_template(spark):
    """One pattern that only Python reads, and the template keeps its names, units and taxes."""
    raw = {**ENRICHED, "fields": {**ENRICHED["fields"], "twice": {"parser": "regex", "regex": r"(S)h?\1"}}}
    assert not make_template(raw).native
    text = "Shop\nLe 5 mars 2024\nTotal 1\nROWS\n2 kg thing 1.5 10.0\nEND\nTAXES\nA 21% of 10\nEND\n"
    row, made = record(spark, make_template(raw, "x"), text)
    assert made["lines"][0]["line_tax_amount"] == 2.1 and made["lines"][0]["unece_code"] == "KGM" and made["date"].startswith("2024-03-05") and made["tax_lines"][0]["line_tax_amount"] == 2.1
    from tabulon.plans.engine import goes_python
    from tabulon.sources import templates

    templates.register_parser("own", lambda text, settings, options: text)
    try:
        with pytest.raises(TemplateError):
            goes_python(make_template({**raw, "fields": {**raw["fields"], "z": {"parser": "own"}}}), "auto", 1)
    finally:
        del templates.PARSERS["own"]


def test_many_templates_plan_quickly(spark):
    import time

    every = [make_template({**RAW, "keywords": [f"Acme{k} ", "Total"], "issuer": f"Acme{k}"}, f"{k:03}.yml") for k in range(200)]
    frame = spark.createDataFrame([(k, TEXT.replace("Acme", f"Acme{k}", 1)) for k in range(0, 220, 3)], "doc_id int, text string")
    began = time.time()
    found = extract(frame, every)
    rows = found.withColumn("record", F.to_json("record")).collect()
    assert time.time() - began < 60
    assert all((r.template_name, r.error) == ((f"{r.doc_id:03}.yml", None) if r.doc_id < 200 else (None, "no_template")) for r in rows)
    assert all(json.loads(r.record)["amount"] == 1212.63 for r in rows if r.record)
    with pytest.raises(ValueError):
        extract(frame, every, engine="other")
    assert extract(frame, []).where("error = 'no_template' and record is null").count() == len(rows)
