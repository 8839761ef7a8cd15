from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.functions import dates, identifiers, numbers, text
from tabulon.operators import enrich, validate
from tabulon.operators.python_dialect import parse_number
from tabulon.sources.templates import Options


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def column(spark, values, make, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in frame.select("k", make(F.col("v")).alias("x")).orderBy("k").collect()]


NUMBER = st.lists(st.text(alphabet="0123456789.,' \t+-eE", max_size=12), min_size=1, max_size=40)


@given(NUMBER, st.sampled_from([".", ","]))
@settings(max_examples=25, deadline=None)
def test_numbers_as_python_reads_them(spark, values, decimal):
    got = column(spark, values, lambda v: numbers.parse_number(v, decimal))
    for v, g in zip(values, got):
        try:
            want = parse_number(v, decimal)
        except ValueError:
            want = None
        assert g == want, v


def test_number_examples(spark):
    assert column(spark, ["1.234,56", "1'234,5", "x", "12", None], lambda v: numbers.parse_number(v, ",")) == [1234.56, 1234.5, None, 12.0, None]
    assert column(spark, ["-7.9", "7.9", "8"], numbers.parse_integer) == [-7, 7, 8]
    assert column(spark, ["about 1 234,50 kg", "EUR -3", "none", ""], numbers.extract_number) == ["1 234,50", "-3", "none", ""]
    assert column(spark, ["1,234.56", "1.234,56", "12,50", "1 234.50", "1\t2.00"], numbers.loose_amount) == [1234.56, 1234.56, 12.5, 1234.5, None]
    assert column(spark, [2.675, 1.005, 0.125, -0.125], numbers.round_cents, "double") == [2.68, 1.01, 0.13, -0.13]


def test_dates(spark):
    values = ["2024-02-29", "29.02.2024", "02/03/2024", "31/12/2024", "5 March 2024", "Mar 5, 2024", "30/02/2024", "", None, "  2024-1-5 ", "07/08/69", "1 Octember 2024"]
    got = column(spark, values, lambda v: dates.parse_date(v, ("%d.%m.%Y", "%d/%m/%y", "%Q")))
    assert got == [datetime(2024, 2, 29), datetime(2024, 2, 29), datetime(2024, 2, 3), datetime(2024, 12, 31), datetime(2024, 3, 5), datetime(2024, 3, 5), None, None, None, datetime(2024, 1, 5), datetime(1969, 8, 7), None]
    assert column(spark, ["Tue, 5 Mar 2024 10:00", "March", None], dates.parse_date_fuzzy) == [datetime(2024, 3, 5, 10), None, None]


GENERAL = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "d/M/yy", "d-MMM-yyyy", "EEEE, d MMMM yyyy", "yyyyMMdd", "dd.MM.yy H:m")


def test_general_forms_need_no_format(spark):
    day = datetime(2021, 11, 23, 4, 5, 6)
    for pattern in GENERAL:
        shown = one(spark, F.date_format(F.lit(day), pattern))
        found = one(spark, dates.parse_date(F.lit(shown)))
        assert found is not None and found.date() == day.date() and found == dates.read_date(shown), pattern


def test_months_in_words(spark):
    values = {
        "5. März 2024": (2024, 3, 5), "5 mars 2024": (2024, 3, 5), "1er août 2023": (2023, 8, 1), "12 de febrero de 2024": (2024, 2, 12), "3 mei 2024": (2024, 5, 3), "24 grudnia 2022": (2022, 12, 24),
        "Montag, 5. Mär. 2024": (2024, 3, 5), "5th of March, 2024": (2024, 3, 5), "March 5th 2024": (2024, 3, 5), "05-JUN-24": (2024, 6, 5), "lunes 5 de agosto de 2024": (2024, 8, 5), "3 maggio 1999": (1999, 5, 3), "20240305": (2024, 3, 5),
        "03/04/24": (2024, 3, 4), "31/12/99": (1999, 12, 31), "30 février 2024": None, "5 Foo 2024": None, "March 2024": None, "99999999": None, "5": None,
    }
    want = [None if v is None else datetime(*v) for v in values.values()]
    assert column(spark, list(values), dates.parse_date) == want
    assert [dates.read_date(v) for v in values] == want
    assert one(spark, dates.parse_date(F.lit("5 mars 2024"), languages=["de"])) is None
    assert one(spark, dates.parse_date(F.lit("5 März 2024"), languages=["de"])) == datetime(2024, 3, 5)


def test_both_engines_read_the_same_dates(spark):
    import random

    r = random.Random(6)
    parts = ["1", "05", "31", "12", "2024", "24", "99", "-", "/", ".", " ", ", ", " de ", "mars", "März", "Mar", "may", "décembre", "th", "er", "Monday ", "x", "T", "10:30", ":59", "1º", "İ"]
    values = ["".join(r.choices(parts, k=r.randint(1, 7))) for _ in range(1500)]
    values += [f"{r.randint(0, 33)}{s}{r.choice(['mars', 'Juni', 'Feb', 'dic', 'sept.', '7', '13'])}{s}{r.choice(['2024', '24', '70', '1'])}" for s in ("-", "/", ".", " ", ". ") for _ in range(120)]
    formats, languages = ("%d.%m.%Y", "%y-%m-%d"), ("fr", "de")
    got = column(spark, values, lambda v: dates.parse_date(v, formats, languages=languages))
    assert got == [dates.read_date(v, formats, languages) for v in values]
    assert 100 < sum(x is not None for x in got) < 1500


def test_identifiers(spark):
    good = "GB82 WEST 1234 5698 7654 32"
    assert column(spark, [good, good.replace("82", "83"), "GB82", None], identifiers.is_iban) == [True, False, False, False]
    assert column(spark, ["NL123456789B01", "nl 123456789 b01", "ATU12345678", "RO12", "RO1", "XX1", "DE123456789\n"], identifiers.is_vat) == [True, True, True, True, False, False, True]
    assert column(spark, ["DEUTDEFF", "DEUTDEFF500", "DEUTDEFF50", "deutdeff"], identifiers.is_bic) == [True, True, False, True]
    assert column(spark, [good, "BG123456789", "DEUTDEFF", "x"], identifiers.classify) == ["iban", "vat", "bic", None]


def test_text(spark):
    assert column(spark, ["é ﬁ ½ ß", None, "abc"], text.strip_accents) == ["e fi 1⁄2 ß", None, "abc"]
    assert column(spark, ["--A b!", "!!", "x"], text.slug) == ["a-b", "template", "x"]
    assert column(spark, ['a<b>:"/\\|?*\x01'], text.safe_file_part) == ["a_b_________"]
    assert column(spark, ["　a\x1cb \t\n", " ", ""], text.strip) == ["　a\x1cb \t\n".strip(), "", ""]
    assert column(spark, ["a\r\nb\rc﻿"], text.clean_reader_text) == ["a\nb\nc"]
    assert text.java_date_format("%d.%m.%Y at %H:%M") == "dd.MM.yyyy' at 'HH:mm" and text.java_date_format("%Q") is None
    assert column(spark, ["A É  b"], lambda v: text.prepare(v, True, True, True, (("b", "[b]"),))) == ["ae[b]"]


def test_units(spark):
    assert column(spark, [" Stück ", "KG", "LTR", "furlong", None], enrich.unit_code) == ["H87", "KGM", "LTR", None, None]
    assert len(enrich.UNIT_CODES) == 73 and len(set(enrich.UNIT_CODES.values())) == 15


def test_vocabulary():
    assert (len(validate.INVOICE_FIELDS), len(validate.LINE_FIELDS), len(validate.TAX_LINE_FIELDS)) == (40, 18, 4)
    assert validate.unknown(["amount_x", "date_x", "iban", "invoice_numbr", "zzz"]) == {"invoice_numbr": "invoice_number", "zzz": None}
    assert Options().decimal_separator == "."


@pytest.mark.parametrize(("taxes", "want"), [([(21.0, 5.0, 0.0), (0.0, 5.0, 0.0)], 21.0), ([(21.0, 5.0, 0.0), (6.0, 0.0, 1.0)], None), ([(21.0, 0.0, 0.0)], None), ([(21.0, None, 1.0), (21.0, 3.0, None)], 21.0)])
def test_single_rate(spark, taxes, want):
    rows = spark.createDataFrame([(taxes,)], "t array<struct<line_tax_percent:double,price_subtotal:double,line_tax_amount:double>>")
    assert rows.select(enrich.single_active_rate(F.col("t"), ["line_tax_percent", "price_subtotal", "line_tax_amount"]).alias("x")).first().x == want
