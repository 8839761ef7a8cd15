"""Orders printed as invoice texts, in several layouts; the base tables hold the truth."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.binding import computed

#: Order of an invoice's lines; lines that agree in all of these are alike.
ITEM_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
UNITS = ("pcs", "kg", "Litre", " HR ", "crate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Read(dict):
    """A line's columns by name, keeping which were asked for."""

    def __missing__(self, name: str) -> Column:
        return self.setdefault(name, F.col(name))


def items_by_order(spark: SparkSession, sf_dir: str, each: Callable[[Mapping[str, Column]], Column] | None = None) -> DataFrame:
    """``l_orderkey`` and ``items``, the order's lines as a sorted array: whole, or what ``each`` makes of one.

    Lines are shuffled as they lie: collected before, they would be sorted and spilled on both sides. ``each``
    runs in compiled code, as a lambda over the array would not, and only columns up to the last that it
    reads are kept, as lines that agree in these give the same. sort_array compares rows as they are,
    array_sort by a lambda.
    """
    read = _Read()
    made = each(read) if each else None
    order = ITEM_ORDER[: max(map(ITEM_ORDER.index, read)) + 1] if each else ITEM_ORDER
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *order).repartition("l_orderkey")
    lines = computed(lines, F.struct(*order, *([made.alias("made")] if each else [])), "item")
    items = F.sort_array(F.collect_list("item"))
    return lines.groupBy("l_orderkey").agg((F.transform(items, lambda x: x["made"]) if each else items).alias("items"))


def orders_with_items(spark: SparkSession, sf_dir: str, each: Callable[[Mapping[str, Column]], Column] | None = None) -> DataFrame:
    """Every order with its customer's name and ``items`` as of :func:`items_by_order`; no lines give an empty array.

    The names come first: joined last, every order would be shuffled with all its lines.
    """
    lines = items_by_order(spark, sf_dir, each)
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left").join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    return joined.withColumn("items", F.coalesce("items", F.array().cast(lines.schema["items"].dataType)))


def money(value: Column) -> Column:
    return value.cast("decimal(18,2)").cast("string")


def european(value: Column) -> Column:
    """1.234,56"""
    return F.translate(grouped(value), ",.", ".,")


def grouped(value: Column) -> Column:
    """1,234.56"""
    return F.format_number(value.cast("decimal(18,2)"), 2)


def unit(partkey: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, UNITS)), (partkey % len(UNITS) + 1).cast("int"))


def _head(day: Column) -> list[Column]:
    return [F.lit("Tabulon Trading\nInvoice Number: INV-"), F.col("o_orderkey").cast("string"), F.lit("\nInvoice Date: "), day, F.lit("\nCustomer: "), F.coalesce("c_name", F.lit("-")), F.lit("\n")]


def _plain_line(x: Mapping[str, Column]) -> Column:
    return F.concat(F.lit("Part "), x["l_partkey"].cast("string"), F.lit(" qty "), money(x["l_quantity"]), F.lit(" unit ["), unit(x["l_partkey"]), F.lit("] price "), money(x["l_extendedprice"]), F.lit(" code "), x["l_returnflag"], F.lit("\n"))


def _nested_line(x: Mapping[str, Column]) -> Column:
    return F.concat(F.lit("Item "), x["l_partkey"].cast("string"), F.lit("\n  note supplier "), x["l_suppkey"].cast("string"), F.lit("\nPage 1 of 2\n\n  note flag "), x["l_returnflag"], F.lit("\n  sum "), money(x["l_extendedprice"]), F.lit("\n  note after\n"))


def _sections_line(x: Mapping[str, Column]) -> Column:
    flag = x["l_returnflag"]
    return F.when(flag.isin("A", "N", "R"), F.concat(flag, F.lit(": "), x["l_partkey"].cast("string"), F.lit(" at "), european(x["l_extendedprice"]), F.lit("\n")))


def _tabular_line(x: Mapping[str, Column]) -> Column:
    return F.concat(F.date_format(x["l_shipdate"], "MM/dd/yyyy"), F.lit("  "), x["l_partkey"].cast("string"), F.lit("  "), grouped(x["l_extendedprice"]), F.lit("\n   \n"))


def _plain(lines: Column) -> Column:
    return F.concat(*_head(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("ITEMS\n"), F.array_join(lines, ""), F.lit("END ITEMS\nTotal: "), money(F.col("o_totalprice")), F.lit(" USD\n"))


def _nested(lines: Column) -> Column:
    return F.concat(*_head(F.date_format("o_orderdate", "d MMMM yyyy")), F.lit("ITEMS\n"), F.array_join(lines, ""), F.lit("END ITEMS\nmore\nEND ITEMS\nTotal: "), money(F.col("o_totalprice")), F.lit(" USD\n"))


def _sections(lines: Column) -> Column:
    one = lambda flag: F.concat(F.lit(f"Section {flag}\n"), F.array_join(F.filter(lines, lambda x: x.startswith(f"{flag}: ")), ""), F.lit("Close\nfooter\n"))
    return F.concat(*_head(F.date_format("o_orderdate", "dd/MM/yyyy")), one("A"), one("N"), one("R"), F.lit("Total: "), european(F.col("o_totalprice")), F.lit(" EUR\n"))


def _tabular(lines: Column) -> Column:
    return F.concat(*_head(F.date_format("o_orderdate", "MMMM d, yyyy")), F.lit("Shipped   Part   Amount\n"), F.array_join(lines, ""), F.lit("End of table\nTotal: "), grouped(F.col("o_totalprice")), F.lit(" USD\n"))


#: How each layout prints a line, and a page of the lines printed.
LAYOUTS = {"plain": (_plain_line, _plain), "nested": (_nested_line, _nested), "sections": (_sections_line, _sections), "tabular": (_tabular_line, _tabular)}


def invoices(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """``doc_id`` (the order's key) and ``text`` of every order in one layout; each is printed once, whatever filters look at it."""
    line, page = LAYOUTS[layout]
    return computed(orders_with_items(spark, sf_dir, line), page(F.col("items")), "text").select(F.col("o_orderkey").alias("doc_id"), "text")


HEAD_FIELDS = {"invoice_number": r"Invoice Number: INV-(\d+)", "date": r"Invoice Date: (.+)", "customer": {"parser": "regex", "regex": r"Customer: (.+)"}}

TEMPLATES = {
    "plain": {
        "keywords": ["Tabulon Trading", "ITEMS", "qty "], "issuer": "Tabulon Trading",
        "fields": HEAD_FIELDS | {
            "amount": r"Total: ([\d.]+) USD", "currency": {"parser": "static", "value": "USD"}, "static_kind": "invoice",
            "prices": {"parser": "regex", "regex": r"price ([\d.]+)", "type": "float"},
            "lines": {"parser": "lines", "start": r"ITEMS\n", "end": "END ITEMS", "types": {"qty": "float", "price_subtotal": "float", "product": "int"},
                      "line": r"Part (?P<product>\d+) qty (?P<qty>[\d.]+) unit \[(?P<uom>[^\]]*)\] price (?P<price_subtotal>[\d.]+) code (?P<code>\w)"},
        },
    },
    "nested": {
        "keywords": ["Tabulon Trading", "  note supplier"], "fields": HEAD_FIELDS | {
            "amount": r"Total: ([\d.]+) USD",
            "lines": {"parser": "lines", "start": r"ITEMS\n", "end": r"END ITEMS", "end_match": "last", "first_line": r"^Item (?P<product>\d+)", "line": r"note (?P<line_note>.*)", "last_line": r"sum (?P<price_subtotal>[\d.]+)",
                      "skip_line": ["^Page \\d+"], "types": {"price_subtotal": "float", "product": "int"}},
        },
    },
    "sections": {
        "keywords": ["Tabulon Trading", "Section A"], "options": {"decimal_separator": ",", "date_formats": ["%d/%m/%Y"]}, "fields": HEAD_FIELDS | {
            "amount": r"Total: ([\d.,]+) EUR",
            "lines": {"parser": "lines", "rules": [
                {"start": "Section [AN]\n", "end": "Close", "line": r"(?P<code>\w): (?P<product>\d+) at (?P<price_subtotal>[\d.,]+)", "types": {"price_subtotal": "float"}},
                {"start": "Section R\n", "end": "Close", "line": [r"(?P<code>R): (?P<product>\d+) at (?P<price_subtotal>[\d.,]+)", r"(?P<line_note>.+)"], "types": {"price_subtotal": "float"}, "replace": {"code": ["R", "returned"]}},
            ]},
        },
    },
    "tabular": {
        "keywords": ["Tabulon Trading", "Shipped   Part"], "fields": HEAD_FIELDS | {"amount": r"Total: ([\d.,]+) USD"},
        "tables": [{"start": "Amount\n", "end": "End of table", "body": r"(?P<date_shipped>\d\d/\d\d/\d{4})  (?P<part>\d+)  (?P<amount_line>[\d.,]+)", "types": {"part": "int"}, "fields": {"amount_line": {"group": "sum"}, "date_shipped": {"group": "min"}}}],
    },
}
