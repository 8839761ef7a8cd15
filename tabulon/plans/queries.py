"""The queries of the extraction engine, each with the SQL that gives its rows from the base tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import dates, identifiers, numbers
from tabulon.functions import text as tx
from tabulon.functions.binding import computed
from tabulon.operators import candidates, cascade, enrich, fields, labels, lines, matching, tables, validate, wordboxes
from tabulon.plans.engine import extract, extract_wide
from tabulon.sinks import flat
from tabulon.sources import pages
from tabulon.sources.rendered import TEMPLATES, UNITS, european, invoices, money, orders_with_items, table, unit
from tabulon.sources.templates import make_template

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ITEMS = """items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"""


def query(sql: str | None = None):
    def register(made):
        QUERIES[made.__name__] = made
        if sql:
            ORACLES[made.__name__] = sql
        return made

    return register


def template(layout: str):
    return make_template(TEMPLATES[layout], f"{layout}.yml")


def wide(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    return extract_wide(invoices(spark, sf_dir, layout), template(layout))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# End to end


@query("""
SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS amount, 'USD' AS currency, c_name AS customer,
  CAST(count(l_orderkey) AS BIGINT) AS n_lines, coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS lines_total
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE TRUE
GROUP BY ALL HAVING count(l_orderkey) > 0""")
def invoice_extract(spark, sf_dir):
    """The flagship: invoices printed from the base tables, read back through one template."""
    found = wide(spark, sf_dir, "plain")
    total = F.aggregate("lines", F.lit(0).cast("decimal(28,2)"), lambda a, r: (a + r["price_subtotal"].cast("decimal(18,2)")).cast("decimal(28,2)"))
    return found.select("doc_id", "invoice_number", F.date_format("date", "yyyy-MM-dd").alias("day"), "amount", "currency", "customer", F.size("lines").cast("bigint").alias("n_lines"), total.cast("decimal(38,2)").alias("lines_total"))


@query("""SELECT o_orderkey AS doc_id, 'Tabulon Trading' AS issuer, o_totalprice AS amount, CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS BIGINT) AS n_lines, CASE WHEN o_orderkey % 4 = 0 THEN 'plain.yml' WHEN o_orderkey % 4 = 1 THEN 'nested.yml' WHEN o_orderkey % 4 = 2 THEN 'sections.yml' ELSE 'tabular.yml' END AS template_name
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def extract_records(spark, sf_dir):
    """Invoices of all four layouts through the whole engine; the record is a VARIANT."""
    from tabulon.sources.rendered import LAYOUTS

    order = ("plain", "nested", "sections", "tabular")
    chosen = lambda key, made: reduce(lambda so_far, k: so_far.when(F.pmod(key, F.lit(4)) == k, made(order[k])), (1, 2), F.when(F.pmod(key, F.lit(4)) == 0, made(order[0]))).otherwise(made(order[3]))
    rows = orders_with_items(spark, sf_dir, lambda x: chosen("l_orderkey", lambda name: LAYOUTS[name][0](x)))
    text = chosen("o_orderkey", lambda name: LAYOUTS[name][1](F.col("items")))
    printed = rows.where(F.size("items") > 0).select(F.col("o_orderkey").alias("doc_id"), F.size("items").cast("bigint").alias("printed"), text.alias("text"))
    found = extract(printed, [template(x) for x in order]).where("error is null")
    items = lambda path: F.size(F.try_variant_get("record", path, "array<variant>"))
    n = F.coalesce(*[F.when(items(path) >= 0, items(path)) for path in ("$.lines", "$.part")], F.lit(1)).cast("bigint")
    return found.select("doc_id", F.lit("Tabulon Trading").alias("issuer"), F.try_variant_get("record", "$.amount", "double").alias("amount"), n.alias("n_lines"), "template_name")


# Matching

KEYWORD_TEMPLATES = (
    {"template_name": "license", "keywords": ["icens", "ersion"], "exclude_keywords": ["GNU"], "priority": 7},
    {"template_name": "english", "keywords": ["the ", "and "], "priority": 3},
    {"template_name": "french", "keywords": ["les ", "des "], "exclude_keywords": ["the "]},
    {"template_name": "second-french", "keywords": "les "},
    {"template_name": "rest", "keywords": ["e"], "priority": 1},
)
_WANT = {
    "license": "contains(text, 'icens') AND contains(text, 'ersion') AND NOT contains(text, 'GNU')", "english": "contains(text, 'the ') AND contains(text, 'and ')",
    "french": "contains(text, 'les ') AND contains(text, 'des ') AND NOT contains(text, 'the ')", "second-french": "contains(text, 'les ')", "rest": "contains(text, 'e')",
}


def _keyword_templates():
    return [make_template(t) for t in KEYWORD_TEMPLATES]


@query(" UNION ALL ".join(f"SELECT doc_id, '{n}' AS template_name FROM documents WHERE {w}" for n, w in _WANT.items()))
def match_keywords(spark, sf_dir):
    return matching.all_matches(docs(spark, sf_dir), _keyword_templates()).select("doc_id", "template_name")


@query(f"SELECT doc_id FROM documents WHERE {_WANT['license']}")
def match_exclude(spark, sf_dir):
    return docs(spark, sf_dir).where(matching.matches(F.col("text"), _keyword_templates()[0])).select("doc_id")


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {_WANT[n]} THEN '{n}'" for n in ("license", "french", "second-french", "english", "rest")) + " END AS template_name FROM documents")
def match_priority_top1(spark, sf_dir):
    every = _keyword_templates()
    names = F.array(*[F.lit(t.name) for t in every])
    return matching.match(docs(spark, sf_dir), every).select("doc_id", F.try_element_at(names, F.col("template_index") + 1).alias("template_name"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {_WANT[n]} THEN '{n}'" for n in ("license", "french", "second-french", "english", "rest")) + " END AS template_name FROM documents")
def match_automaton(spark, sf_dir):
    """As match_priority_top1, by one Aho-Corasick pass: the way for large template sets."""
    every = _keyword_templates()
    names = F.array(*[F.lit(t.name) for t in every])
    return matching._automaton_match(docs(spark, sf_dir), every, "text").select("doc_id", F.try_element_at(names, F.col("template_index") + 1).alias("template_name"))


# Text preparation


@query("SELECT doc_id, md5(replace(text, ' ', '')) AS prepared FROM documents")
def prep_whitespace(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.prepare(F.col("text"), remove_whitespace=True)).alias("prepared"))


@query("SELECT doc_id, md5(lower(text)) AS prepared FROM documents")
def prep_lowercase(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.prepare(F.col("text"), lowercase=True)).alias("prepared"))


@query("SELECT doc_id, md5(strip_accents(text)) AS prepared FROM documents")
def prep_accents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.prepare(F.col("text"), remove_accents=True)).alias("prepared"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(th)(e)', '\2-\1', 'g'), '[.,]+', '$', 'g')) AS prepared FROM documents")
def prep_replace(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.prepare(F.col("text"), replace=(("(th)(e)", r"\2-\1"), ("[.,]+", "$")))).alias("prepared"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' \t\r') <> '')) AS BIGINT) AS n_lines, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS cleaned FROM documents")
def reader_text(spark, sf_dir):
    """A reader's text with uniform line ends, and its lines that aren't blank."""
    cleaned = tx.clean_reader_text(F.col("text"))
    some = F.filter(F.split("text", "\n"), lambda l: F.trim(l, F.lit(" \t\r")) != "")
    return docs(spark, sf_dir).select("doc_id", F.size(some).cast("bigint").alias("n_lines"), F.md5(cleaned).alias("cleaned"))


# Fields


def _prices(group: str | None, spark, sf_dir, kind: str = "float"):
    spec = {"parser": "regex", "regex": [r"price ([\d.]+)"], "type": kind} | ({"group": group} if group else {})
    made = make_template({"keywords": "ITEMS", "fields": {"x": spec}})
    value, _ = fields.field_value(F.col("text"), made.fields[0], made.options)
    return invoices(spark, sf_dir, "plain").select("doc_id", value.alias("x"))


@query("SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS invoice_number, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def regex_single(spark, sf_dir):
    return wide(spark, sf_dir, "plain").select("doc_id", "invoice_number", "customer")


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, CAST(count(DISTINCT l_extendedprice) AS BIGINT) AS n_values, sum(DISTINCT CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM items GROUP BY ALL")
def regex_multi_distinct(spark, sf_dir):
    found = _prices(None, spark, sf_dir).where(F.size("x") > 0)
    total = F.aggregate("x", F.lit(0).cast("decimal(28,2)"), lambda a, v: (a + v.cast("decimal(18,2)")).cast("decimal(28,2)"))
    return found.select("doc_id", F.size("x").cast("bigint").alias("n_values"), total.cast("decimal(38,2)").alias("total"))


for _how, _sql in {
    "first": "arg_min(l_extendedprice, pos)", "last": "arg_max(l_extendedprice, pos)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)",
    "sum": "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)", "join": "string_agg(printf('%.2f', l_extendedprice), ' ' ORDER BY pos)",
}.items():

    def _make(how=_how):
        def grouped(spark, sf_dir):
            x = F.round("x", 2).alias("x") if how == "sum" else F.col("x")
            return _prices(how, spark, sf_dir, "float" if how != "join" else "x").where("x is not null").select("doc_id", x) if how != "join" else _joined(spark, sf_dir)

        grouped.__name__ = f"regex_{how}"
        grouped.__doc__ = f"Prices of each invoice, grouped by {how}."
        return grouped

    def _joined(spark, sf_dir):
        made = make_template({"keywords": "ITEMS", "fields": {"x": {"parser": "regex", "regex": r"price ([\d.]+)", "group": "join"}}})
        value, _ = fields.field_value(F.col("text"), made.fields[0], made.options)
        return invoices(spark, sf_dir, "plain").select("doc_id", value.alias("x")).where("x is not null")

    query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, {_sql} AS x FROM items GROUP BY l_orderkey")(_make())


@query("SELECT o_orderkey AS doc_id, o_totalprice AS amount FROM orders")
def number_us(spark, sf_dir):
    shown = F.format_string("%,.2f", "o_totalprice")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), numbers.parse_number(shown, ".").alias("amount"))


@query("SELECT o_orderkey AS doc_id, o_totalprice AS amount FROM orders")
def number_eu(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), numbers.parse_number(european(F.col("o_totalprice")), ",").alias("amount"))


@query("SELECT o_orderkey AS doc_id, printf('%.2f', o_totalprice) AS found, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
def extract_number(spark, sf_dir):
    found = numbers.extract_number(F.concat(F.lit("about "), money(F.col("o_totalprice")), F.lit(" EUR incl.")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), found.alias("found"), numbers.parse_integer(found).alias("whole"))


@query("SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_formats_tiered(spark, sf_dir):
    """Seven printed forms by turns, read by a template's own formats first and the general ones then."""
    forms = ("yyyy-MM-dd", "dd.MM.yyyy", "d MMMM yyyy", "MMMM d, yyyy", "dd/MM/yy", "MMM d, yyyy", "d MMM yyyy")
    shown = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        shown = F.when(F.pmod("o_orderkey", F.lit(len(forms))) == k, F.date_format("o_orderdate", form)).otherwise(shown)
    parsed = dates.parse_date(F.concat(F.lit(" "), shown), ("%d.%m.%Y", "%d/%m/%y", "%m-%d-%Y hh:mm"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format(parsed, "yyyy-MM-dd").alias("day"))


@query(f"WITH {ITEMS} SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS date_order, o_totalprice AS amount, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) + CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount_all, 'invoice' AS kind, 'EUR' AS currency FROM orders JOIN items ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate, o_totalprice")
def legacy_typed(spark, sf_dir):
    """Fields typed by their names: date*, amount*, sum_amount* (a list, summed), static_*."""
    made = make_template({"keywords": "qty ", "required_fields": ["amount"], "fields": {"date_order": r"Invoice Date: (.+)", "amount": r"Total: ([\d.]+)", "sum_amount_all": [r"price ([\d.]+)", r"Total: ([\d.]+)"], "static_kind": "invoice"}})
    found = extract_wide(invoices(spark, sf_dir, "plain"), made)
    return found.select("doc_id", F.date_format("date_order", "yyyy-MM-dd").alias("date_order"), "amount", F.round("amount_all", 2).alias("amount_all"), "kind", "currency")


@query("SELECT o_orderkey AS doc_id, 'Tabulon Trading' AS issuer, 'plain.yml' AS template_name, 'USD' AS currency, 'invoice' AS kind, 'Invoice from Tabulon Trading' AS \"desc\" FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def static_fields(spark, sf_dir):
    return wide(spark, sf_dir, "plain").select("doc_id", "issuer", "template_name", "currency", "kind", "desc")


@query("SELECT doc_id, CASE WHEN contains(text, '@') THEN 'USD' ELSE 'EUR' END AS currency FROM documents WHERE contains(text, 'the ')")
def currency_default(spark, sf_dir):
    made = make_template({"keywords": "the ", "fields": {"currency": {"parser": "regex", "regex": r"(@)", "replace": ["@", "USD"]}}})
    found = extract_wide(docs(spark, sf_dir), made)
    return found.select("doc_id", F.coalesce("currency", F.element_at("currency_all", 1)).alias("currency"))


# Lines


def _exploded(frame: DataFrame) -> DataFrame:
    return frame.select("doc_id", F.posexplode("lines").alias("pos", "row")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "row.*")


_UNIT_SQL = "[" + ", ".join(f"'{u.strip()}'" for u in UNITS) + f"][CAST(l_partkey % {len(UNITS)} AS BIGINT) + 1]"


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, pos, l_partkey AS product, l_quantity AS qty, {_UNIT_SQL} AS uom, l_extendedprice AS price_subtotal, l_returnflag AS code FROM items")
def lines_basic(spark, sf_dir):
    return _exploded(wide(spark, sf_dir, "plain")).select("doc_id", "pos", "product", "qty", "uom", "price_subtotal", "code")


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, pos, l_partkey AS product, 'supplier ' || l_suppkey || chr(10) || 'flag ' || l_returnflag AS line_note, l_extendedprice AS price_subtotal FROM items")
def lines_first_last(spark, sf_dir):
    """Rows over several lines, with page footers to skip and a block up to the last end."""
    return _exploded(wide(spark, sf_dir, "nested")).select("doc_id", "pos", "product", "line_note", "price_subtotal")


@query("SELECT o_orderkey AS doc_id, CAST(count(l_orderkey) * 5 + 2 AS BIGINT) AS n_lines, CAST(count(l_orderkey) AS BIGINT) AS n_skipped FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def lines_skip(spark, sf_dir):
    """Lines of the block that aren't blank and aren't skipped, and those that are skipped."""
    rule = template("nested").fields[-1].rules[0]
    block = F.element_at(lines.blocks(F.col("text"), rule), 1)
    kept, skipped = lines.counts(block, rule)
    return invoices(spark, sf_dir, "nested").select("doc_id", kept.cast("bigint").alias("n_lines"), skipped.cast("bigint").alias("n_skipped"))


@query(f"WITH {ITEMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, pos) AS place FROM items) SELECT l_orderkey AS doc_id, place AS pos, CASE l_returnflag WHEN 'R' THEN 'returned' ELSE l_returnflag END AS code, CAST(l_partkey AS VARCHAR) AS product, l_extendedprice AS price_subtotal FROM ranked")
def lines_rules(spark, sf_dir):
    """Repeated blocks, several rules, replacements within rules and European numbers."""
    return _exploded(wide(spark, sf_dir, "sections")).select("doc_id", "pos", "code", "product", "price_subtotal")


@query("SELECT o_orderkey AS doc_id, CAST(count(l_orderkey) FILTER (l_returnflag = f) AS BIGINT) AS n_lines, f AS section FROM orders CROSS JOIN (VALUES ('A'), ('N'), ('R')) AS t(f) LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, f")
def lines_blocks(spark, sf_dir):
    rule = make_template({"keywords": "Section", "fields": {"lines": {"parser": "lines", "start": "Section ", "end": "Close", "line": "(?P<name>.+)"}}}).fields[0].rules[0]
    found = invoices(spark, sf_dir, "sections").select("doc_id", F.explode(lines.blocks(F.col("text"), rule)).alias("block"))
    return found.select("doc_id", (F.size(F.filter(F.split("block", "\n"), lambda l: l != "")) - 1).cast("bigint").alias("n_lines"), F.left("block", F.lit(1)).alias("section"))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def lineless(spark, sf_dir):
    """Documents whose template declares lines and finds none."""
    made = make_template({"keywords": "ITEMS", "fields": {"lines": TEMPLATES["plain"]["fields"]["lines"]}, "required_fields": ["issuer"]})
    return extract(invoices(spark, sf_dir, "plain"), [made]).where("lineless").select("doc_id")


# Tables


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, pos, l_partkey AS part, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_extendedprice AS amount_line FROM items")
def tables_columns(spark, sf_dir):
    rule = make_template({**TEMPLATES["tabular"], "tables": [{k: v for k, v in TEMPLATES["tabular"]["tables"][0].items() if k != "fields"}]}).tables[0]
    found = tables.columns(F.col("text"), rule, template("tabular").options, F.col("found"))
    rows = computed(invoices(spark, sf_dir, "tabular"), tables.rows(F.col("text"), rule), "found").select("doc_id", *[v.alias(k) for k, v in found.items()]).select("doc_id", F.posexplode(F.arrays_zip("part", "date_shipped", "amount_line")).alias("pos", "row"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "row.part", F.date_format("row.date_shipped", "yyyy-MM-dd").alias("shipped"), "row.amount_line")


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount_line, strftime(min(l_shipdate), '%Y-%m-%d') AS first_shipped, CAST(count(*) AS BIGINT) AS n_parts FROM items GROUP BY l_orderkey")
def tables_group(spark, sf_dir):
    found = wide(spark, sf_dir, "tabular").where("amount_line is not null")
    return found.select("doc_id", F.round("amount_line", 2).alias("amount_line"), F.date_format("date_shipped", "yyyy-MM-dd").alias("first_shipped"), F.size("part_all").cast("bigint").alias("n_parts"))


# Enrichment


def _rows(spark, sf_dir, each, name: str = "lines") -> DataFrame:
    return orders_with_items(spark, sf_dir).where(F.size("items") > 0).select(F.col("o_orderkey").alias("doc_id"), F.transform("items", each).alias(name))


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, pos, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag ELSE CAST(l_partkey AS VARCHAR) END AS name, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS VARCHAR) END AS description, l_extendedprice AS price_unit FROM items")
def alias_rename(spark, sf_dir):
    """Two rows in one array: some have the canonical name beside the other one, which then stays."""
    made = _rows(spark, sf_dir, lambda x: F.struct(x["l_partkey"].cast("string").alias("description"), F.when(x["l_partkey"] % 2 == 0, x["l_returnflag"]).alias("name"), x["l_extendedprice"].alias("unit_price")))
    renamed, columns = enrich.rename_aliases(F.col("lines"), ["description", "name", "unit_price"])
    return _exploded(made.select("doc_id", renamed.alias("lines"))).select("doc_id", "pos", "name", "description", "price_unit")


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, pos, ['H87', 'KGM', 'LTR', 'HUR', NULL][CAST(l_partkey % 5 AS BIGINT) + 1] AS unece_code FROM items")
def uom_lookup(spark, sf_dir):
    made = _rows(spark, sf_dir, lambda x: F.struct(unit(x["l_partkey"]).alias("uom")))
    coded, _ = enrich.with_unit_codes(F.col("lines"), ["uom"])
    return _exploded(made.select("doc_id", coded.alias("lines"))).select("doc_id", "pos", "unece_code")


def _taxed(spark, sf_dir, taxes) -> DataFrame:
    made = _rows(spark, sf_dir, lambda x: F.struct(x["l_extendedprice"].alias("price_subtotal"), F.when(x["l_returnflag"] != "N", x["l_returnflag"]).alias("line_tax_code")))
    given, _ = enrich.apply_tax(F.col("lines"), ["price_subtotal", "line_tax_code"], taxes, ["line_tax_code", "line_tax_percent", "price_subtotal"])
    return _exploded(made.select("doc_id", given.alias("lines"))).select("doc_id", "pos", "line_tax_percent", "line_tax_amount")


def _tax_rows(*rows: tuple[str, float, float]):
    return F.array(*[F.struct(F.lit(c).alias("line_tax_code"), F.lit(p).alias("line_tax_percent"), F.lit(s).alias("price_subtotal")) for c, p, s in rows])


_AMOUNT = "CAST(round(CAST(l_extendedprice * p / 100 AS DECIMAL(20,6)), 2) AS DOUBLE)"


@query(f"WITH {ITEMS}, rated AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 9.0 WHEN 'R' THEN 21.0 END::DOUBLE AS p FROM items) SELECT l_orderkey AS doc_id, pos, p AS line_tax_percent, {_AMOUNT} AS line_tax_amount FROM rated")
def tax_by_code(spark, sf_dir):
    """The last row of a code counts; two active rates leave lines without a code as they are."""
    return _taxed(spark, sf_dir, _tax_rows(("A", 6.0, 0.0), ("A", 9.0, 10.0), ("R", 21.0, 10.0)))


@query(f"WITH {ITEMS}, rated AS (SELECT *, 21.0::DOUBLE AS p FROM items) SELECT l_orderkey AS doc_id, pos, p AS line_tax_percent, {_AMOUNT} AS line_tax_amount FROM rated")
def tax_single_rate(spark, sf_dir):
    return _taxed(spark, sf_dir, _tax_rows(("X", 0.0, 5.0), ("Y", 21.0, 10.0), ("Z", 6.0, 0.0)))


@query(f"WITH {ITEMS}, rated AS (SELECT *, CAST(round(l_tax * 100) AS DOUBLE) AS p FROM items) SELECT l_orderkey AS doc_id, pos, CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE {_AMOUNT} END AS line_tax_amount FROM rated")
def tax_compute(spark, sf_dir):
    made = _rows(spark, sf_dir, lambda x: F.struct(x["l_extendedprice"].alias("price_subtotal"), F.round(x["l_tax"] * 100).alias("line_tax_percent"), F.when(x["l_returnflag"] == "A", F.lit(1.0)).alias("line_tax_amount")))
    filled, _ = enrich.compute_tax(F.col("lines"), ["price_subtotal", "line_tax_percent", "line_tax_amount"])
    return _exploded(made.select("doc_id", filled.alias("lines"))).select("doc_id", "pos", "line_tax_amount")


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, sum(CAST(l_discount AS DECIMAL(18,2))) <> 0 AND abs(sum(CAST(l_discount AS DECIMAL(18,2))) - CAST(0.2 AS DECIMAL(18,2))) > 0.02 AS differs FROM items GROUP BY l_orderkey")
def tax_total_check(spark, sf_dir):
    made = _rows(spark, sf_dir, lambda x: F.struct(x["l_discount"].alias("line_tax_amount")))
    return made.select("doc_id", enrich.tax_total_differs(F.col("lines"), ["line_tax_amount"], F.lit(0.2)).alias("differs"))


# Validation


@query("SELECT doc_id, CASE WHEN contains(text, '@') THEN '' ELSE 'email' END AS missing FROM documents WHERE contains(text, 'e')")
def required_fields(spark, sf_dir):
    made = make_template({"keywords": "e", "required_fields": ["email", "issuer"], "fields": {"email": {"parser": "regex", "regex": "(@)", "group": "first"}}})
    return extract_wide(docs(spark, sf_dir), made).select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("SELECT doc_id, CASE WHEN contains(text, 'the ') THEN 'invoice_numbr' ELSE '' END AS unknown, CASE WHEN contains(text, 'the ') THEN 'strict_fields' END AS error FROM documents WHERE contains(text, 'e')")
def schema_unknown(spark, sf_dir):
    made = make_template({"keywords": "e", "required_fields": ["issuer"], "options": {"strict_fields": True, "extra_fields": ["kind"]}, "fields": {"static_kind": "x", "amount_x": {"parser": "static", "value": 1}, "invoice_numbr": {"parser": "regex", "regex": "(the )", "group": "first"}}})
    return extract(docs(spark, sf_dir).where(F.col("text").contains("e")), [made]).select("doc_id", F.array_join("unknown", ",").alias("unknown"), "error")


_ODD = ("invoice_numbr", "iban_code", "partner_nme", "amount_x", "date_x", "vat", "lin")


@query(f"""SELECT o_orderkey AS doc_id, n AS name, CASE n WHEN 'invoice_numbr' THEN 'invoice_number' WHEN 'partner_nme' THEN 'partner_name' END AS suggestion
FROM (SELECT o_orderkey, {list(_ODD)}[CAST(o_custkey % {len(_ODD)} AS BIGINT) + 1] AS n FROM orders) WHERE NOT starts_with(n, 'amount') AND NOT starts_with(n, 'date') AND n <> 'vat'""")
def schema_suggestions(spark, sf_dir):
    """A field name for each order; names outside the vocabulary with the known one that is close."""
    found = validate.unknown(_ODD)
    table_of = F.create_map(*[F.lit(x) for pair in found.items() for x in pair])
    name = F.element_at(F.array(*map(F.lit, _ODD)), (F.col("o_custkey") % len(_ODD) + 1).cast("int"))
    named = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), name.alias("name"))
    return named.where(F.col("name").isin(list(found))).withColumn("suggestion", F.try_element_at(table_of, "name"))


# Cascade


@query("SELECT o_orderkey AS doc_id, CASE WHEN n = 0 OR o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS reader_rank, CAST(n AS BIGINT) AS n_lines FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)")
def cascade_best_reader(spark, sf_dir):
    """The first reader loses the item block of two documents of three; the second one's run is then better."""
    printed = invoices(spark, sf_dir, "plain")
    spoilt = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("text")).otherwise(F.regexp_replace("text", r"Part \d+ qty [^\n]*\n", ""))
    both = printed.withColumn("run", F.explode(F.array(F.struct(F.lit(0).alias("reader_rank"), F.lit("quick").alias("reader"), spoilt.alias("text")), F.struct(F.lit(1).alias("reader_rank"), F.lit("slow").alias("reader"), F.col("text").alias("text"))))).select("doc_id", "run.*")
    made = make_template({**TEMPLATES["plain"], "keywords": ["Tabulon Trading", "ITEMS"]}, "plain.yml")
    n = F.greatest(F.size(F.try_variant_get("record", "$.lines", "array<variant>")), F.lit(0)).cast("bigint")
    return cascade.cascade(both, [made], wanted={"n_lines": n}).select("doc_id", "reader_rank", "n_lines")


# Word boxes


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, coalesce(string_agg(l_partkey || ' ' || l_returnflag, chr(10) ORDER BY pos) FILTER (pos BETWEEN 2 AND 4), '') AS cropped FROM items GROUP BY l_orderkey")
def wordbox_crop_lines(spark, sf_dir):
    """Two words on a line for each item, a little askew; lines two to four are cut out and joined."""
    box = lambda x, i: F.array(*[F.struct(F.lit(1).alias("page"), F.lit(x0).alias("x0"), (i * 20.0 + 10 + dy).alias("y0"), F.lit(x0 + 30).alias("x1"), (i * 20.0 + 20).alias("y1"), w.alias("text")) for x0, dy, w in ((50.0, 1.5, x["l_returnflag"]), (10.0, 0.0, x["l_partkey"].cast("string")))])
    made = orders_with_items(spark, sf_dir).where(F.size("items") > 0).select(F.col("o_orderkey").alias("doc_id"), F.flatten(F.transform("items", box)).alias("boxes"))
    area = {"f": 1, "l": 1, "r": 72, "x": 0, "y": 25, "W": 200, "H": 60}
    return made.select("doc_id", wordboxes.crop(F.col("boxes"), area).alias("cropped"))


# Identifiers

_BBAN = "'WEST' || lpad(CAST(c_custkey AS VARCHAR), 14, '0')"
_CHECK = "98 - CAST(CAST('32142829' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') || '161100' AS HUGEINT) % 97 AS INTEGER)"


def _ibans(spark, sf_dir) -> DataFrame:
    bban = F.concat(F.lit("WEST"), F.lpad(F.col("c_custkey").cast("string"), 14, "0"))
    check = 98 - identifiers.mod97(F.concat(F.lit("GB00"), bban))
    off = F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0)
    value = F.concat(F.lit("GB"), F.lpad((check + off).cast("string"), 2, "0"), bban)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), value.alias("iban"))


@query(f"SELECT c_custkey AS doc_id, 'GB' || lpad(CAST({_CHECK} + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR), 2, '0') || {_BBAN} AS iban, c_custkey % 5 <> 0 AS valid FROM customer")
def iban_mod97(spark, sf_dir):
    return _ibans(spark, sf_dir).select("doc_id", "iban", identifiers.is_iban(F.col("iban")).alias("valid"))


@query("SELECT c_custkey AS doc_id, c_custkey % 3 <> 2 AS valid FROM customer")
def vat_format(spark, sf_dir):
    key = F.col("c_custkey")
    value = F.when(key % 3 == 0, F.concat(F.lit("nl "), F.lpad(key.cast("string"), 9, "0"), F.lit("b01"))).when(key % 3 == 1, F.concat(F.lit("DE"), F.lpad(key.cast("string"), 9, "1"))).otherwise(F.concat(F.lit("DE"), F.lpad(key.cast("string"), 10, "1")))
    return table(spark, sf_dir, "customer").select(key.alias("doc_id"), identifiers.is_vat(value).alias("valid"))


@query("SELECT c_custkey AS doc_id, c_custkey % 3 <> 2 AS valid FROM customer")
def bic_format(spark, sf_dir):
    key = F.col("c_custkey")
    value = F.when(key % 3 == 0, F.lit("abnanl2a")).when(key % 3 == 1, F.concat(F.lit("DEUTDEFF"), F.lpad((key % 1000).cast("string"), 3, "0"))).otherwise(F.lit("DEUTDEFF5"))
    return table(spark, sf_dir, "customer").select(key.alias("doc_id"), identifiers.is_bic(value).alias("valid"))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'iban' END AS kind FROM customer UNION ALL SELECT c_custkey, 'vat' FROM customer UNION ALL SELECT c_custkey, 'bic' FROM customer")
def classify_identifier(spark, sf_dir):
    key = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    values = F.explode(F.array("iban", F.concat(F.lit("BG"), key), F.lit("DEUTDEFF500")))
    return _ibans(spark, sf_dir).select("doc_id", values.alias("value")).select("doc_id", identifiers.classify(F.col("value")).alias("kind"))


# Authoring


def _sheet(spark, sf_dir) -> DataFrame:
    text = F.concat(F.lit("Invoice No: A"), F.col("o_orderkey").cast("string"), F.lit("\nInvoice Date: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nDue Date: "), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd"), F.lit("\nBIC: DEUTDEFF500\nTax 1.00 of\nTotal: "), money(F.col("o_totalprice") + 2000), F.lit("\n"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


_SHEET_AMOUNT = "CAST(round(CAST(o_totalprice + 2000 AS DECIMAL(18,4)), 2) AS DOUBLE)"


@query(f"SELECT o_orderkey AS doc_id, 'amount' AS kind, {_SHEET_AMOUNT} AS number FROM orders UNION ALL SELECT o_orderkey, 'amount', 1.0::DOUBLE FROM orders")
def cand_amounts(spark, sf_dir):
    return candidates.find(_sheet(spark, sf_dir)).where("kind = 'amount'").select("doc_id", "kind", F.col("parsed_num").alias("number"))


@query("SELECT o_orderkey AS doc_id, strftime(d, '%Y-%m-%d') AS day FROM (SELECT o_orderkey, o_orderdate AS d FROM orders UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY FROM orders)")
def cand_dates(spark, sf_dir):
    return candidates.find(_sheet(spark, sf_dir)).where("kind = 'date'").select("doc_id", F.date_format("parsed_ts", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS n_dates, CAST(1 AS BIGINT) AS n_amounts FROM orders")
def cand_amount_not_in_date(spark, sf_dir):
    """12.05 within 12.05.2024 is no amount."""
    text = F.concat(F.lit("on "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" paid "), money(F.col("o_totalprice")))
    sheet = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    found = candidates.find(sheet)
    return found.groupBy("doc_id").agg(F.count_if(F.col("kind") == "date").alias("n_dates"), F.count_if(F.col("kind") == "amount").alias("n_amounts"))


@query(f"SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS day_due, {_SHEET_AMOUNT} AS amount, 'DEUTDEFF500' AS bic FROM orders")
def suggest_fields(spark, sf_dir):
    found = candidates.suggest_in(_sheet(spark, sf_dir))
    return found.select("doc_id", F.date_format("date", "yyyy-MM-dd").alias("day"), F.date_format("date_due", "yyyy-MM-dd").alias("day_due"), "amount", "bic")


@query("SELECT o_orderkey AS doc_id, 'A' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS date_due, printf('%.2f', CAST(o_totalprice + 2000 AS DECIMAL(18,4))) AS amount, 'DEUTDEFF500' AS bic FROM orders")
def labels_detect(spark, sf_dir):
    return labels.find_wide(_sheet(spark, sf_dir), ["invoice_number", "date", "date_due", "amount", "bic"])


# Sinks


@query(f"WITH {ITEMS} SELECT o_orderkey AS doc_id, o_totalprice AS amount, l_partkey AS line_product, l_extendedprice AS line_price_subtotal FROM orders JOIN items ON l_orderkey = o_orderkey")
def csv_explode(spark, sf_dir):
    """One row for each line, the other columns repeated."""
    found = wide(spark, sf_dir, "plain").select("doc_id", "amount", F.transform("lines", lambda r: F.struct(r["product"].alias("product"), r["price_subtotal"].alias("price_subtotal"))).alias("lines"))
    return flat.exploded(found)


@query(f"""WITH {ITEMS} SELECT o_orderkey AS doc_id, printf('%.2f', o_totalprice) AS amount, '[' || string_agg('{{"product":' || l_partkey || ',"code":"' || l_returnflag || '"}}', ',' ORDER BY pos) || ']' AS lines FROM orders JOIN items ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def csv_flat_json(spark, sf_dir):
    """Lists as JSON text in one cell."""
    found = wide(spark, sf_dir, "plain").select("doc_id", money(F.col("amount")).alias("amount"), F.transform("lines", lambda r: F.struct(r["product"].alias("product"), r["code"].alias("code"))).alias("lines"))
    return flat.cells(found).withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query("""SELECT key FROM (SELECT DISTINCT unnest(['issuer', 'template_name', 'currency', 'desc'] || CASE WHEN contains(text, '@') THEN ['email'] ELSE [] END) AS key FROM documents WHERE contains(text, 'e'))""")
def key_union(spark, sf_dir):
    """Ordered union of the keys of all records: the header of a flat file."""
    made = make_template({"keywords": "e", "required_fields": ["issuer"], "fields": {"email": {"parser": "regex", "regex": "(@)", "group": "first"}}})
    return flat.key_union(extract(docs(spark, sf_dir), [made]), "names").select("key")


@query("SELECT o_orderkey AS doc_id, '_' || o_orderpriority || '__' || strftime(o_orderdate, '%Y-%m-%d') || '.pdf' AS file_name FROM orders")
def filename_sanitize(spark, sf_dir):
    made = F.concat(tx.safe_file_part(F.concat(F.lit("/"), F.col("o_orderpriority"), F.lit(":?"))), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".pdf"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), made.alias("file_name"))


@query("SELECT p_partkey AS doc_id, CASE WHEN s = '' THEN 'template' ELSE s END AS slug FROM (SELECT p_partkey, trim(regexp_replace(lower('--' || p_type || ' ' || p_name || '! '), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), tx.slug(F.concat(F.lit("--"), "p_type", F.lit(" "), "p_name", F.lit("! "))).alias("slug"))


_BARE = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|title))\\b[^>]*>', chr(10), 'g')"
_SIGNS = f"regexp_replace({_BARE}, '<[^>]*>', '', 'g')"
for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _SIGNS = f"replace({_SIGNS}, '{_entity}', '{_sign}')"


@query(f"SELECT page_id, url, trim(regexp_replace(regexp_replace({_SIGNS}, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM pages")
def pages_text_extract(spark, sf_dir):
    """The text of web pages, as a reader gives it."""
    return pages.page_text(table(spark, sf_dir, "pages"))


@query("SELECT doc_id, CAST(0 AS BIGINT) AS found FROM documents")
def negatives(spark, sf_dir):
    """No invoice template takes ordinary documents."""
    every = [template(x) for x in TEMPLATES]
    return extract(docs(spark, sf_dir), every).select("doc_id", F.col("record").isNotNull().cast("bigint").alias("found"))


# Dates in words


_MONTHS = {"de": ("Januar Februar März April Mai Juni Juli August September Oktober November Dezember", "{d}. {m} {y}"), "fr": ("janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "{d} {m} {y}"), "nl": ("januari februari maart april mei juni juli augustus september oktober november december", "{d} {m} {y}"), "es": ("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre", "{d} de {m} de {y}"), "it": ("gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre", "{d} {m} {y}"), "pl": ("stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia", "{d} {m} {y}")}


@query("SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_languages(spark, sf_dir):
    """The day in words of six languages and in digits with two for the year, by turns; no format is given."""
    day, month, year = F.dayofmonth("o_orderdate").cast("string"), F.month("o_orderdate"), F.year("o_orderdate").cast("string")
    shown = F.date_format("o_orderdate", "M/d/yy")
    for k, (names, form) in enumerate(_MONTHS.values()):
        parts = {"d": day, "m": F.element_at(F.array(*map(F.lit, names.split())), month), "y": year}
        text = F.concat(*[parts[p] if p in parts else F.lit(p) for p in re.split(r"{(\w)}", form) if p])
        shown = F.when(F.pmod("o_orderkey", F.lit(len(_MONTHS) + 1)) == k, text).otherwise(shown)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format(dates.parse_date(shown, languages=list(_MONTHS)), "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def date_output(spark, sf_dir):
    return flat.cells(wide(spark, sf_dir, "plain").select("doc_id", F.col("date").alias("day")), "%d/%m/%Y").withColumn("doc_id", F.col("doc_id").cast("bigint"))


# The Python dialect, with all that the native plan adds


def _taxed_sheet(spark, sf_dir) -> DataFrame:
    line = lambda x: F.concat(F.lit("row "), x["l_partkey"].cast("string"), F.lit(" "), unit(x["l_partkey"] * 0 + 1), F.lit(" "), money(x["l_extendedprice"]), F.when(x["l_returnflag"] == "N", "").otherwise(F.concat(F.lit(" "), x["l_returnflag"])), F.lit("\n"))
    text = F.concat(F.lit("TAXED\nROWS\n"), F.array_join(F.transform("items", line), ""), F.lit("ROWSEND\nRATES\nA 9\nR 21\nRATESEND\n"))
    return orders_with_items(spark, sf_dir).where(F.size("items") > 0).select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


_TAXED = {
    "keywords": "TAXED", "template_name": "taxed", "required_fields": ["issuer"], "fields": {
        "twice": {"parser": "regex", "regex": r"(S)\nRO?\1?", "group": "first"},
        "lines": {"parser": "lines", "start": "ROWS\n", "end": "ROWSEND", "line": [r"row (?P<code>\d+) (?P<uom>\S+) (?P<price_subtotal>[\d.]+) (?P<line_tax_code>\w)$", r"row (?P<code>\d+) (?P<uom>\S+) (?P<price_subtotal>[\d.]+)$"], "types": {"price_subtotal": "float"}},
        "tax_lines": {"parser": "lines", "start": "RATES\n", "end": "RATESEND", "line": r"(?P<line_tax_code>\w) (?P<vat_rate>\d+)$", "types": {"vat_rate": "float"}},
    },
}


@query(f"WITH {ITEMS}, rated AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 9.0 WHEN 'R' THEN 21.0 END::DOUBLE AS p FROM items) SELECT l_orderkey AS doc_id, pos, CAST(l_partkey AS VARCHAR) AS code, 'KGM' AS unece_code, p AS line_tax_percent, {_AMOUNT} AS line_tax_amount FROM rated")
def python_dialect_taxed(spark, sf_dir):
    """A template with a back reference, which only Python reads: units and taxes come all the same."""
    made = make_template(_TAXED)
    assert not made.native
    found = extract(_taxed_sheet(spark, sf_dir), [made])
    rows = found.select("doc_id", F.posexplode(F.try_variant_get("record", "$.lines", "array<struct<code:string,unece_code:string,line_tax_percent:double,line_tax_amount:double>>")).alias("pos", "row"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "row.*")


@query("SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS amount, CAST((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS BIGINT) AS n_lines FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def python_engine(spark, sf_dir):
    """The flagship's invoices by the Python dialect alone."""
    found = extract(invoices(spark, sf_dir, "plain"), [template("plain")], engine="python").where("error is null")
    value = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind)
    return found.select("doc_id", value("invoice_number", "string").alias("invoice_number"), F.left(value("date", "string"), F.lit(10)).alias("day"), value("amount", "double").alias("amount"), F.size(value("lines", "array<variant>")).cast("bigint").alias("n_lines"))


@query("SELECT o_orderkey AS doc_id, o_orderkey % 30 AS template_index, o_totalprice AS amount FROM orders")
def many_templates(spark, sf_dir):
    """Thirty templates, by their number in the text."""
    text = F.concat(F.lit("Firm "), (F.col("o_orderkey") % 30).cast("string"), F.lit(";\nTotal "), money(F.col("o_totalprice")))
    every = [make_template({"template_name": f"{k}", "keywords": f"Firm {k};", "required_fields": ["amount"], "fields": {"amount": r"Total (\S+)"}}) for k in range(30)]
    found = extract(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), every)
    return found.select("doc_id", F.col("template_name").cast("bigint").alias("template_index"), F.try_variant_get("record", "$.amount", "double").alias("amount"))


# Seams and rules of the grammar


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, string_agg(l_partkey || '', ',' ORDER BY pos) FILTER (pos <= 2) AS inside, CAST(count(*) AS BIGINT) AS n_all FROM items GROUP BY l_orderkey")
def area_fields(spark, sf_dir):
    """One field sees the first two rows of the page by their boxes, another the whole text."""
    box = lambda x, i: F.struct(F.lit(1).alias("page"), F.lit(10.0).alias("x0"), (i * 20.0 + 10).alias("y0"), F.lit(40.0).alias("x1"), (i * 20.0 + 20).alias("y1"), F.concat(F.lit("p"), x["l_partkey"].cast("string")).alias("text"))
    rows = orders_with_items(spark, sf_dir).where(F.size("items") > 0)
    printed = rows.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("top\n"), F.array_join(F.transform("items", lambda x: F.concat(F.lit("p"), x["l_partkey"].cast("string"))), "\n")).alias("text"), F.transform("items", box).alias("boxes"))
    area = {"f": 1, "l": 1, "r": 72, "x": 0, "y": 0, "W": 100, "H": 45}
    part = lambda **more: {"parser": "regex", "regex": r"p(\d+)"} | more
    made = make_template({"keywords": "p", "required_fields": ["issuer"], "fields": {"inside": part(area=area, group="join"), "every": {"parser": "lines", "start": "top", "end": r"\Z", "line": r"p(?P<x>\d+)"}}})
    found = extract(printed, [made], engine="python")
    return found.select("doc_id", F.replace(F.try_variant_get("record", "$.inside", "string"), F.lit(" "), F.lit(",")).alias("inside"), F.size(F.try_variant_get("record", "$.every", "array<variant>")).cast("bigint").alias("n_all"))


@query(f"SELECT c_custkey AS doc_id, 'GB' || lpad(CAST({_CHECK} AS VARCHAR), 2, '0') || {_BBAN} AS iban FROM customer WHERE c_custkey % 5 <> 0")
def iban_spaced(spark, sf_dir):
    """IBANs printed in blocks of four; those with wrong check digits are none."""
    spaced = F.regexp_replace("iban", "(....)(?=.)", "$1 ")
    sheet = _ibans(spark, sf_dir).select("doc_id", F.concat(F.lit("pay to "), spaced, F.lit(" now")).alias("text"))
    return candidates.find(sheet).where("kind = 'iban'").select("doc_id", F.col("parsed_str").alias("iban"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'amount' ELSE 'amount,note' END AS present FROM orders")
def emission_filter(spark, sf_dir):
    """A field whose only value is empty isn't there."""
    text = F.concat(F.lit("Total "), money(F.col("o_totalprice")), F.lit("\nNote<"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("x"), F.lit(">"))
    made = make_template({"keywords": "Total", "required_fields": ["issuer"], "fields": {"amount": r"Total (\S+)", "note": {"parser": "regex", "regex": "Note<(.?)>"}}})
    found = extract(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), [made])
    return found.select("doc_id", F.array_join(F.array_sort(F.array_intersect("names", F.array(F.lit("amount"), F.lit("note")))), ",").alias("present"))


@query("SELECT o_orderkey AS doc_id, printf('%.2f', o_totalprice) AS code, o_totalprice AS amount FROM orders")
def table_overwrites(spark, sf_dir):
    """A table's column takes the place of a field of its name; blank lines in it count for nothing."""
    text = F.concat(F.lit("code first\nTABLE\n   \n\n"), money(F.col("o_totalprice")), F.lit(" "), money(F.col("o_totalprice")), F.lit("\n \t\nEND"))
    made = make_template({"keywords": "TABLE", "required_fields": ["issuer"], "fields": {"code": {"parser": "regex", "regex": r"code (\w+)"}}, "tables": [{"start": "TABLE", "end": "END", "body": r"(?P<code>[\d.]+) (?P<amount>[\d.]+)"}]})
    found = extract_wide(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), made)
    return found.select("doc_id", "code", "amount")


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, pos, l_partkey AS product FROM items")
def lines_old_form(spark, sf_dir):
    """Lines at a template's top level."""
    raw = {k: v for k, v in TEMPLATES["plain"]["fields"]["lines"].items() if k != "parser"}
    made = make_template({"keywords": "ITEMS", "required_fields": ["issuer"], "lines": raw})
    return _exploded(extract_wide(invoices(spark, sf_dir, "plain"), made)).select("doc_id", "pos", "product")


@query(f"WITH {ITEMS} SELECT l_orderkey AS doc_id, pos, l_partkey AS product FROM items")
def lines_separated(spark, sf_dir):
    """Rows that a pattern separates, not the end of a line."""
    text = F.concat(F.lit("ROWS\n"), F.array_join(F.transform("items", lambda x: F.concat(F.lit("part\nno "), x["l_partkey"].cast("string"))), "\n - \n"), F.lit("\nEND"))
    printed = orders_with_items(spark, sf_dir).where(F.size("items") > 0).select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    made = make_template({"keywords": "ROWS", "required_fields": ["issuer"], "fields": {"lines": {"parser": "lines", "rules": [{"start": "ROWS\n", "end": "END", "line_separator": r"\n\s*-\s*\n", "line": r"no (?P<product>\d+)", "types": {"product": "int"}}]}}})
    return _exploded(extract_wide(printed, made)).select("doc_id", "pos", "product")


@query("SELECT o_orderkey AS doc_id, CAST(length(c_name) * 2 AS BIGINT) AS size FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def own_parser(spark, sf_dir):
    """A parser of one's own: the length of the customer's name, times a setting."""
    from tabulon.sources import templates

    templates.PARSERS["length of name"] = lambda text, settings, options: F.length(F.regexp_extract(text, "Customer: (.+)", 1)) * settings["times"]
    try:
        made = make_template({"keywords": "ITEMS\nPart", "required_fields": ["issuer"], "fields": {"size": {"parser": "length of name", "times": 2}}})
        found = extract(invoices(spark, sf_dir, "plain").where(~F.col("text").contains("Customer: -")), [made])
    finally:
        del templates.PARSERS["length of name"]
    return found.where("template_name is not null").select("doc_id", F.try_variant_get("record", "$.size", "bigint").alias("size"))


# Authoring, scores, reports


@query(f"SELECT o_orderkey AS doc_id, 'A' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS day, {_SHEET_AMOUNT} AS amount FROM orders")
def draft_extract(spark, sf_dir):
    """A template drafted from one sheet reads all of them."""
    from tabulon.operators import authoring

    sheets = _sheet(spark, sf_dir)
    sample = sheets.orderBy("doc_id").first().text
    draft = authoring.draft_template(sample)
    made = make_template({**draft, "keywords": ["Invoice No"], "required_fields": ["amount"]}, "draft")
    found = extract_wide(sheets, made)
    return found.select("doc_id", "invoice_number", F.date_format("date", "yyyy-MM-dd").alias("day"), "amount")


@query("SELECT o_orderkey AS doc_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS BIGINT) AS matched, CAST(3 AS BIGINT) AS total FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def score_records(spark, sf_dir):
    """Of three golden fields one is wrong in every third record."""
    from tabulon.plans.score import score

    found = extract(invoices(spark, sf_dir, "plain"), [template("plain")]).where("error is null").select("doc_id", "record")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"))
    golden = F.struct(F.col("o_orderkey").cast("string").alias("invoice_number"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("1899-01-01")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return score(found, orders.select(F.col("o_orderkey").alias("doc_id"), F.parse_json(F.to_json(golden)).alias("record"))).select("doc_id", "matched", "total")


@query("SELECT o_orderkey AS doc_id, f AS field, CASE f WHEN 'amount' THEN printf('%.2f', o_totalprice) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value, f = 'amount' AS required FROM orders CROSS JOIN (VALUES ('amount'), ('date')) AS t(f)")
def explain_fields(spark, sf_dir):
    """Each field of each record as a row, the required ones marked."""
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), money(F.col("o_totalprice")).alias("amount"), F.col("o_orderdate").alias("date"))
    return flat.explain(made, ["amount"], "doc_id")


__all__ = ["ORACLES", "QUERIES"]
