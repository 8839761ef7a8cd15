"""Work that must not grow with what nobody reads, or be done more than once."""

import cProfile
import pstats

import pyarrow as pa

from tabulon.operators import python_dialect
from tabulon.plans import engine
from tabulon.plans.queries import QUERIES, template


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_invoices_are_printed_once_and_unread_fields_not_made(spark, sf_dir):
    for name in ("regex_single", "static_fields", "lines_basic"):
        assert _plan(QUERIES[name](spark, sf_dir)).count("END ITEMS\nTotal: ,") == 1, name
    assert "price (" not in _plan(QUERIES["regex_single"](spark, sf_dir)) and "price (" in _plan(QUERIES["lines_basic"](spark, sf_dir))


def test_lines_join_last(spark, sf_dir):
    plan = _plan(QUERIES["python_engine"](spark, sf_dir))
    assert 0 < plan.index("(o_orderkey#") < plan.index("(o_custkey#")


def test_lines_are_shuffled_as_they_lie_and_printed_before_they_are_collected(spark, sf_dir):
    for name, printed, unread in (("static_fields", "Part ", "l_shipdate"), ("extract_records", "  note supplier ", None), ("lines_rules", " at ", "l_shipdate")):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
        collected, shuffled = plan.split("partial_collect_list")[1].split("REPARTITION_BY_COL")  # no such shuffle before
        assert printed in collected and "collect_list" not in shuffled, name
        assert unread is None or unread not in plan, name


def test_invoices_are_those_printed_from_whole_lines(spark, tmp_path):
    import datetime

    from pyspark.sql import functions as F

    from tabulon.sources import rendered

    day = datetime.datetime(1996, 2, 29)
    line = lambda order, number, part, flag="A", price=1234.5, when=day: (order, part, 7, number, 2.0, price, 0.1, 0.2, flag, "O", when)
    kind = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    lines = [
        line(1, 2, 30), line(1, 1, 31, "R"), line(1, 1, 9, "N", -0.005), line(1, 1, 9, "N", -0.005, day + datetime.timedelta(1)), line(1, 1, 9, "N", -0.005), line(2, 1, None), line(2, None, 5, "A: A"),
        line(2, 3, 6, None), line(2, 3, 6, "X"), line(3, 1, 8, "A", None), line(None, 1, 1), line(9, 1, 1),
    ]
    spark.createDataFrame(lines, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, k % 2, 10.0 * k, day) for k in (1, 2, 3, 4, 4)] + [(None, 1, 1.0, day)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "c")], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    whole = rendered.orders_with_items(spark, str(tmp_path))
    in_order = {r.o_orderkey: [x.l_partkey for x in r["items"]] for r in whole.collect()}
    assert in_order == {None: [], 1: [9, 9, 9, 31, 30], 2: [5, None, 6, 6], 3: [8], 4: []}
    for layout, (each, page) in rendered.LAYOUTS.items():
        got = sorted((r.doc_id or 0, r.text or "") for r in rendered.invoices(spark, str(tmp_path), layout).collect())
        want = sorted((r.o_orderkey or 0, r.text or "") for r in whole.select("o_orderkey", page(F.transform("items", each)).alias("text")).collect())
        assert got == want and len(got) == 6, layout
        assert got[1][1].count("Part 9 ") == (3 if layout == "plain" else 0)


def test_table_rows_are_found_once(spark, sf_dir):
    assert _plan(QUERIES["tables_columns"](spark, sf_dir)).count(r"(\d\d/\d\d/\d{4})") == 1


def _text(k: int) -> str:
    rows = "".join(f"Part {k + j} qty {j}.50 unit [pcs] price {k}.25 code R\n" for j in range(4))
    return f"Tabulon Trading\nInvoice Number: INV-{k}\nInvoice Date: 1995-03-{k % 28 + 1:02}\nCustomer: c\nITEMS\n{rows}END ITEMS\nTotal: {k}.00 USD\n"


def test_python_dialect_calls_for_a_document():
    made, texts = template("plain"), [_text(k) for k in range(200)]
    run = cProfile.Profile()
    records = run.runcall(lambda: [python_dialect.as_json(python_dialect.extract(t, made)) for t in texts])
    assert pstats.Stats(run).total_calls < 320 * len(texts)  # 402 each, before
    assert '"amount": 7.0' in records[7] and '"product": 10, "qty": 3.5, "uom": "pcs", "price_subtotal": 7.25' in records[7]


def test_numbers_read_the_short_way():
    for value, decimal, want in (("17.00", ".", 17.0), ("5.", ".", 5.0), (".5", ".", 0.5), ("1,5", ",", 1.5), ("1.234,5", ",", 1234.5), ("1'000.5", ".", 1000.5), ("5'0", "'", 50.0)):
        assert python_dialect.parse_number(value, decimal) == want


def test_boxes_are_listed_by_field():
    kind = pa.list_(pa.struct([("page", pa.int32()), ("x0", pa.float64()), ("text", pa.string())]))
    box = lambda k: {"page": k, "x0": k / 2, "text": f"w{k}" if k else None}
    for rows in ([[box(0), box(1)], None, [], [box(2)]], [None, None], [[None, box(1)]]):
        every = pa.array(rows, kind)
        assert engine._listed(every) == rows and engine._listed(every.slice(1)) == rows[1:]


def test_boxes_are_not_sent_without_areas(spark):
    docs = spark.createDataFrame([(1, "x", [])], "id int, text string, boxes array<struct<page:int,x0:double,y0:double,x1:double,y1:double,text:string>>")
    from tabulon.sources.templates import make_template

    made = make_template({"keywords": "x", "required_fields": ["issuer"]})
    assert "boxes" not in _plan(engine.extract(docs, [made], engine="python").select("id", "record")).split("ArrowEvalPython")[1].split("\n")[0]


def test_accents_go_by_pieces():
    import tracemalloc

    from tabulon.functions import text

    every = pa.array([None, "", *[f"é{k}" + "ü" * 5_000 for k in range(2_000)]])
    tracemalloc.start()
    got = text.strip_accents.func(every)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist()[:3] == [None, "", "e0" + "u" * 5_000] and len(got) == len(every) and len(text.strip_accents.func(every.slice(0, 0))) == 0
    assert peak < every.nbytes / 2


def test_let_derives_no_types_for_each_row(spark):
    from pyspark.sql import functions as F

    from tabulon.functions.binding import let

    frame = spark.range(2).select(F.when(F.col("id") > 0, F.col("id")).alias("x"))
    bound = frame.select(let(F.col("x"), lambda v: F.struct(v.alias("a"), (v + v).alias("b"))).alias("s"))
    assert sorted((r.s.a or 0, r.s.b or 0) for r in bound.collect()) == [(0, 0), (1, 2)] and "transform(" not in _plan(bound)


def test_lines_by_one_pass_are_those_of_single_lines(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tabulon.operators import lines
    from tabulon.sources.templates import make_template

    texts = [
        "S\nA 1\n  n x \nskip\n\r\n n \nt 5\n n after\nA 2\nn  y\x1c\r\n\n nz\nt 7 A 3\nA 4\nE\nn out\nS\nn lost\nA 5\nn q\nE\n", "S\nA 9\nE\nS\nn none\nt 1\nE", "S E", "S\n\nE", "", "nothing",
        "S\nb a9\nA 6\nn\nt 8\nA 7\nt 9\nn p\nE tail E\nA 8\nE\n", "S A 1\nn a\nbn b t 1\n n c\nA٣\nn [d\n] e\nE",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    first = {"start": "S", "end": "E", "first_line": r"^A ?(?P<a>\d+)", "line": [r"n (?P<b>.*)", r"n(?P<b>)(?P<c>[^\]]*)$"], "last_line": [r"t (?P<d>[\d.]+)"], "skip_line": ["^skip", "lost"]}
    rules = [
        first, first | {"end_match": "last"}, {k: v for k, v in first.items() if k != "last_line"}, first | {"last_line": [r"t (?P<a>\d)", r"(?P<b>after)"]},
        {"start": "S", "end": "E", "line": r"(?P<b>\w+)\s(?P<c>[^x]*)"}, {"start": "S", "end": "E", "line": [r"^A (?P<a>\d)", r"n (?P<b>.*)|t (?P<c>.)", r"(?P<b>q?)"], "skip_line": "skip"}, {"start": "S", "end": "E", "line": r"\d"},
    ]
    for settings in rules:
        field = make_template({"keywords": "S", "fields": {"lines": {"parser": "lines", **settings}}}).fields[-1]
        got = []
        for passes in (True, False):
            if not passes:
                monkeypatch.setattr(lines, "in_one", lambda rule: False)
            else:
                assert lines.in_one(field.rules[0])
            made = lines.line_items(F.col("text"), field, make_template({"keywords": "S"}).options)
            got.append([r.s for r in docs.orderBy("id").select(F.to_json(made, {"ignoreNullFields": "false"}).alias("s")).collect()])
            monkeypatch.undo()
        assert got[0] == got[1], settings
        assert sum(len(x) > 2 for x in got[0]) > 3


def test_patterns_that_may_take_a_line_end_go_by_single_lines():
    from tabulon.functions.regex_dialect import at_start, line_form, literal

    assert [line_form(p) for p in (r"a\nb", r"[\n]", r"(?i)a", r"(?=a)b", r"a\Z", r"\x0a", "a*+b")] == [None] * 7
    assert line_form(r"[^\]]*\s[\d.]\W" + "[\t-z]") == r"[^\]\n]*[\s&&[^\n]][\d.][\W&&[^\n]][[" + "\t" + r"-z]&&[^\n]]"
    assert at_start("^a") and not at_start("^a|b") and not at_start("a^")
    assert literal(r"END\nX") == "END\nX" and literal("aba") is None and literal("a.") is None


def test_scores_write_no_record_as_text(spark, sf_dir):
    from pyspark.sql import functions as F

    from tabulon.plans.score import score

    rows = lambda *x: spark.createDataFrame(list(x), "doc_id int, j string").select("doc_id", F.try_parse_json("j").alias("record"))
    want = rows((1, '{"a": "12/3", "b": "NaN", "c": "x 1", "d": true, "e": {"x": 1}, "f": null}'), (2, "[1]"), (3, '{"a": "1e0", "b": " 7", "c": "1899-01-01 00:00:00", "d": [1, 2]}'))
    got = rows((1, '{"a": "12/3", "b": "nan", "c": "x 1", "d": "true", "e": {"x": 1}, "f": null}'), (3, '{"a": 1, "b": 7.0, "c": "1899-01-01", "d": "[3, 4]"}'))
    made = score(got, want)
    assert "from_json" not in _plan(made).lower() and "jsontostructs" not in _plan(made).lower()
    assert {r.doc_id: (r.matched, r.total, r.lacking) for r in made.collect()} == {1: (5, 6, ["f"]), 2: (None, None, None), 3: (4, 4, [])}


def test_runs_leave_records_out_before_the_best_is_sought(spark, sf_dir):
    plan = _plan(QUERIES["cascade_best_reader"](spark, sf_dir)).split("\n")
    assert [x for x in plan if "min_by(" in x] and not any("record" in x for x in plan if "min_by(" in x)


def test_strip_is_pythons(spark):
    from pyspark.sql import functions as F

    from tabulon.functions.text import strip

    texts = ["", " ", "a", " a", "a ", "\t a \n", "\x1ca\x85", "!", "~", "\x7f", " \x7f ", "é", " é", " x　 ", "a b", "\xa0", " \xa0 ", "~ ~\r", None]
    made = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    assert [r.s for r in made.select(strip(F.col("t")).alias("s")).collect()] == [t if t is None else t.strip() for t in texts]
    assert _plan(made.select(strip(F.col("t")).alias("s"))).count("ascii(") == 2  # 4 before
