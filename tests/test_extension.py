"""Areas, parsers and plugins of one's own, file names and the command line."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tabulon import __main__ as command
from tabulon.plans import engine
from tabulon.sinks import files
from tabulon.sources import templates


def test_fields_with_an_area_see_its_words(spark):
    raw = {"keywords": "k", "required_fields": ["issuer"], "fields": {"inside": {"parser": "regex", "regex": r"(\d+)", "area": {"f": 1, "l": 1, "r": 72, "x": 0, "y": 0, "W": 50, "H": 50}}, "whole": {"parser": "regex", "regex": r"(\d+)"}}}
    boxes = [(1, 10.0, 10.0, 20.0, 20.0, "1"), (1, 90.0, 10.0, 99.0, 20.0, "2")]
    docs = spark.createDataFrame([(7, "k 5", boxes)], "doc_id int, text string, boxes array<struct<page:int,x0:double,y0:double,x1:double,y1:double,text:string>>")
    made = templates.make_template(raw, "t")
    row = engine.extract_wide(docs, made).first()
    assert (row.doc_id, row.inside, row.whole) == (7, "1", "5")
    record = json.loads(engine.extract(docs, [made]).select(F.to_json("record").alias("r")).first().r)
    assert (record["inside"], record["whole"]) == ("1", "5")
    assert engine.extract_wide(docs.drop("boxes"), made).first().inside == "5"


def test_own_parser_and_plugin(spark, monkeypatch):
    monkeypatch.setitem(templates.PARSERS, "length", lambda text, settings, options: F.length(text) * settings["times"])
    monkeypatch.setitem(engine.PLUGINS, "mark", lambda frame: frame.withColumn("marked", F.lit(True)))
    made = templates.make_template({"keywords": "k", "required_fields": ["issuer"], "fields": {"amount_n": {"parser": "length", "times": 2}}}, "t")
    extractor = engine.Extractor([made])
    row = extractor.extract(spark.createDataFrame([("kkk",)], "text string")).withColumn("record", F.to_json("record")).first()
    assert json.loads(row.record)["amount_n"] == 6 and row.marked


def test_file_names(spark, tmp_path):
    frame = spark.createDataFrame([(datetime(2024, 1, 2), ["a/b", "c"], None)], "date timestamp_ntz, number array<string>, x string")
    name = frame.select(files.file_name(frame, "{date} {number}{x}.pdf").alias("n")).first().n
    assert name == "2024-01-02 a_b.pdf"
    (tmp_path / "in.pdf").write_text("x")
    (tmp_path / "out").mkdir()
    files.place([{"path": f"file:{tmp_path}/in.pdf", "target_name": name}], str(tmp_path / "out"))
    assert (tmp_path / "out" / name).exists() and (tmp_path / "in.pdf").exists()


def test_command_line(spark, tmp_path, capsys):
    for folder in ("texts", "templates"):
        (tmp_path / folder).mkdir()
    (tmp_path / "texts" / "a.txt").write_text("k 12")
    (tmp_path / "texts" / "b.txt").write_text("other")
    (tmp_path / "templates" / "t.json").write_text(json.dumps({"keywords": "k", "required_fields": ["amount"], "fields": {"amount": r"k (\d+)"}}))
    base = [str(tmp_path / "texts"), "--templates", str(tmp_path / "templates")]
    assert command.main(base) == 0
    shown = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [json.loads(r["record"])["amount"] for r in shown] == [12]
    assert command.main([*base, "--errors", "--out", str(tmp_path / "out"), "--template-name", "T"]) == 0
    assert [r.error for r in spark.read.json(str(tmp_path / "out")).collect()] == ["no_template"]


def test_command_line_options(spark, tmp_path, capsys):
    for folder in ("texts", "templates", "named"):
        (tmp_path / folder).mkdir()
    (tmp_path / "texts" / "a.txt").write_text("k 12 on 5 mars 2024")
    (tmp_path / "texts" / "b.txt").write_text("Rechnung\nRechnungsnummer: R-7\nRechnungsdatum: 3. Mai 2024\nGesamtbetrag: 1.234,50\n")
    (tmp_path / "templates" / "t.json").write_text(json.dumps({"keywords": "k", "required_fields": ["amount"], "fields": {"amount": r"k (\d+)", "date": r"on (.*)"}}))
    base = [str(tmp_path / "texts"), "--templates", str(tmp_path / "templates")]
    assert command.main([*base, "--built-in", "--explain", "--copy", str(tmp_path / "named"), "--file-name", "{date} {amount}", "--no-colour"]) == 0
    shown = capsys.readouterr().out
    assert "general-de.json" in shown and "  invoice_number: R-7" in shown and "t.json" in shown
    assert sorted(p.name for p in (tmp_path / "named").iterdir()) == ["2024-03-05 12.0.txt", "2024-05-03 1234.5.txt"] or sorted(p.name for p in (tmp_path / "named").iterdir()) == ["2024-03-05 12.txt", "2024-05-03 1234.5.txt"]
    assert command.main([*base, "--explain"]) == 0 and "no_template" in capsys.readouterr().out
    assert command.main([*base, "--reader", "text", "--engine", "python"]) == 0 and len(capsys.readouterr().out.splitlines()) == 1
    assert command.main([str(tmp_path / "texts" / "b.txt"), "--draft"]) == 0
    draft = json.loads(capsys.readouterr().out)
    assert draft["template"]["keywords"] == ["Rechnung"] and draft["finds"]["invoice_number"] == "R-7"


def test_general_templates():
    every = templates.built_in()
    assert len(every) == 6 and all(t.native and t.priority == 1 for t in every)
    own = templates.make_template({"keywords": "k"}, "general-en.json")
    assert [t.name for t in templates.with_built_in([own])].count("general-en.json") == 1


def test_general_templates_read_plain_invoices(spark):
    texts = {
        "en": ("Invoice\nInvoice Number: A-1\nDate: March 5, 2024\nDue Date: 2024-04-05\nSubtotal 10.00\nTotal Due: $ 1,234.50\n", "A-1", 1234.5),
        "fr": ("Facture\nFacture N° : F/22\nDate : 5 mars 2024\nÉchéance : 5 avril 2024\nTotal TTC : 99,90\n", "F/22", 99.9),
        "nl": ("Factuur\nFactuurnummer: 2024-7\nFactuurdatum: 5 maart 2024\nVervaldatum: 5 april 2024\nTotaal te betalen: € 1.000,00\n", "2024-7", 1000.0),
        "es": ("Factura IVA\nFactura Nº 55\nFecha: 5 de marzo de 2024\nTotal a pagar: 12,00\n", "55", 12.0),
        "it": ("Fattura\nFattura n. 8\nData: 5 marzo 2024\nTotale: 12,00\n", "8", 12.0),
    }
    frame = spark.createDataFrame([(k, v[0]) for k, v in texts.items()], "doc_id string, text string")
    for engine_ in ("native", "python"):
        rows = {r.doc_id: (r.template_name, r.error, json.loads(r.record or "{}")) for r in engine.extract(frame, templates.built_in(), engine=engine_).withColumn("record", F.to_json("record")).collect()}
        for language, (_, number, amount) in texts.items():
            name, error, made = rows[language]
            assert (name, error) == (f"general-{language}.json", None), (language, rows[language])
            assert (made["invoice_number"], made["amount"], made["date"][:10]) == (number, amount, "2024-03-05")


def test_scores(spark):
    from tabulon.plans.score import score

    rows = lambda *x: spark.createDataFrame(list(x), "doc_id int, j string").select("doc_id", F.try_parse_json("j").alias("record"))
    golden = rows((1, '{"a": 1.50, "date": "2024-01-02", "lines": [{"x": 1}, {"x": 2}], "n": "z"}'), (2, '{"a": 1}'), (3, '{"a": "[x]"}'))
    found = rows((1, '{"a": 1.5, "date": "2024-01-02 00:00:00", "lines": [1, 2], "n": "y"}'), (3, '{"a": "[x]"}'))
    assert {r.doc_id: (r.matched, r.total, r.lacking) for r in score(found, golden).collect()} == {1: (3, 4, ["n"]), 2: (0, 1, ["a"]), 3: (1, 1, [])}


def test_logs():
    import logging

    from tabulon import logs

    record = logging.LogRecord("tabulon", logging.WARNING, "x", 1, "a %s", ("b",), None)
    assert json.loads(logs.Lines().format(record))["message"] == "a b" and "WARNING" in logs.Coloured().format(record)
    assert isinstance(logs.configure(as_json=True).formatter, logs.Lines)
