"""Readers, candidates, labels, authoring, sinks, the model seam and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabulon import ai
from tabulon.operators import authoring, candidates, labels
from tabulon.plans.engine import extract
from tabulon.sinks import flat
from tabulon.sources import pages, readers
from tabulon.sources.templates import make_template
from tabulon.streaming import arriving_texts, extract_stream

TEXT = "Acme Ltd\nInvoice No: A-77\nDate: 12.05.2024\nDue Date: 2024-06-11\nIBAN: GB82 WEST 1234 5698 7654 32\nVAT: NL123456789B01\nTotal: 1.234,56\nTax 12,00\n"


def test_candidates(spark):
    frame = spark.createDataFrame([(1, TEXT), (2, ""), (3, None), (None, "on 2024-02-30 or 2024-02-29")], "doc_id int, text string")
    rows = candidates.find(frame).collect()
    kinds = [(r.kind, r.value) for r in rows if r.doc_id == 1]
    assert kinds == [("date", "12.05.2024"), ("date", "2024-06-11"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("vat", "NL123456789B01"), ("amount", "1.234,56"), ("amount", "12,00")]
    assert [r.parsed_ts for r in rows if r.doc_id is None] == [datetime(2024, 2, 29)]
    found = {r.doc_id: r for r in candidates.suggest(candidates.find(frame)).collect()}
    assert found[1].amount == 1234.56 and found[1].date < found[1].date_due and found[1].iban == "GB82WEST12345698765432" and found[None].date_due is None
    assert candidates.find(frame.where("1=0")).count() == 0
    assert all(TEXT[r.start : r.end] == r.value for r in rows if r.doc_id == 1)


def test_labels(spark):
    frame = spark.createDataFrame([(1, TEXT), (2, None), (3, "Totaal = 12,50\nfactuurdatum 1-2-2024")], "doc_id int, text string")
    got = {(r.doc_id, r.field): r.value for r in labels.find(frame).collect()}
    assert got[1, "invoice_number"] == "A-77" and got[1, "date_due"] == "2024-06-11" and got[1, "date"] == "12.05.2024" and got[1, "vat"] == "NL123456789B01" and got[1, "amount"] == "1.234,56"
    assert got[3, "amount"] == "12,50" and got[3, "date"] == "1-2-2024" and not [k for k in got if k[0] == 2]


def test_drafted_templates_find_the_sample(spark):
    draft = authoring.draft_template(TEXT)
    assert draft["keywords"] == ["Acme Ltd"] and {"date", "date_due", "amount", "invoice_number", "vat"} <= set(draft["fields"])
    seen = authoring.preview(TEXT, draft)
    assert seen["amount"] == "1.234,56" and seen["date"] == "12.05.2024" and seen["invoice_number"] == "A-77"
    made = make_template({**draft, "options": {"decimal_separator": ",", "date_formats": ["%d.%m.%Y"]}}, "draft")
    row = extract(spark.createDataFrame([(1, TEXT)], "doc_id int, text string"), [made]).withColumn("record", F.to_json("record")).first()
    assert json.loads(row.record)["amount"] == 1234.56 and row.error is None
    assert authoring.with_regex(draft, "amount", "x")["fields"]["amount"]["regex"] == "x" and draft["fields"]["amount"]["regex"] != "x"
    yaml = pytest.importorskip("yaml")
    assert yaml.safe_load(authoring.to_yaml(draft)) == draft


def test_table_detector_settings():
    assert authoring.table_rules({"1": [{"flavor": "lattice", "columns": "1,2"}], 2: {"flavor": "stream", "columns": "3"}}, {"edge_tol": 5}) == [{"pages": "1", "flavor": "lattice", "edge_tol": 5}, {"pages": "2", "flavor": "stream", "columns": "3", "edge_tol": 5}]
    assert authoring.rows_to_records([["a", ""], ["1", "2"]]) == [{"a": "1", "col_1": "2"}] and authoring.rows_to_records([["1", "2"]], header=False) == [{"col_0": "1", "col_1": "2"}] and authoring.rows_to_records([]) == []


def test_readers(spark, tmp_path):
    assert len(readers.READERS) == 12 and "text" in readers.available_readers()
    assert readers.resolve("a.TXT") == ["text"] and readers.resolve("a.pdf", "tesseract") == ["tesseract"] and readers.resolve("a.pdf")
    with pytest.raises(KeyError):
        readers.resolve("a.pdf", "nothing")
    assert {n for n, r in readers.READERS.items() if r.takes_area} == {"pdfium", "pdftotext", "tesseract", "ocrmypdf"}
    (tmp_path / "x.txt").write_bytes(b"a\r\nb")
    readers.register_reader(readers.Reader("broken", lambda content, area: 1 / 0, lambda: True))
    got = {r.reader: (r.text, r.read_error) for r in readers.reader_texts(readers.read_folder(spark, str(tmp_path)), ["broken", "text"]).collect()}
    assert got["text"] == ("a\nb", None) and got["broken"][0] == "" and "ZeroDivisionError" in got["broken"][1]
    cropped = readers.reader_texts(readers.read_folder(spark, str(tmp_path)), ["text"], area={"f": 1}).first()
    assert "no area" in cropped.read_error
    assert [(r.text, r.doc_id.endswith("x.txt")) for r in readers.read_texts(spark, str(tmp_path)).collect()] == [("a\nb", True)]
    del readers.READERS["broken"]


def test_pages(spark):
    html = "<html><head><title>t</title><style>p{}</style></head><body><script>var a='<p>';</script><p>a &amp; <b>b</b></p><!-- c --><ul><li>x</li><li>y</li></ul></body></html>"
    assert spark.createDataFrame([(html,)], "h string").select(pages.html_text(F.col("h")).alias("t")).first().t == "a & b\nx\ny"


def test_flat_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, datetime(2024, 1, 2), [("a", 1.5), ("b", None)], ["x", "é"]), (2, None, [], None)], "id int, date timestamp_ntz, lines array<struct<name:string,line_tax:double>>, tags array<string>")
    rows = {r.id: r for r in flat.cells(frame).collect()}
    assert rows[1].date == "2024-01-02" and json.loads(rows[1].lines) == [{"name": "a", "line_tax": 1.5}, {"name": "b"}] and rows[2].tags is None
    out = flat.exploded(frame)
    assert out.columns == ["id", "date", "tags", "line_name", "line_tax"] and out.count() == 3
    flat.write_csv(frame, str(tmp_path / "csv"), explode="lines")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    flat.write_json(frame, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    flat.write_xml(frame, str(tmp_path / "xml"))
    text = "".join(p.read_text() for p in (tmp_path / "xml").glob("part*"))
    assert "<data>" in text and "<item id=" in text and "<tags>" in text and "<item>x</item>" in text
    records = [{"a": datetime(2024, 1, 2), "b": [{"c": datetime(2024, 1, 3)}], "d": "é"}]
    flat.dump_json(records, str(tmp_path / "one"))
    assert json.loads((tmp_path / "one.json").read_text()) == [{"a": "2024-01-02", "b": [{"c": "2024-01-03"}], "d": "é"}] and records[0]["a"].year == 2024
    report = flat.explain(frame, ["date"]).collect()
    assert [(r.field, r.required) for r in report[:2]] == [("date", True), ("id", False)]
    assert [r.key for r in flat.key_union(spark.createDataFrame([(["a", "b"],), (["a", "c"],), ([],)], "names array<string>")).collect()] == ["a", "b", "c"]


def test_model_seam(spark):
    docs = spark.createDataFrame([(1, "kk"), (2, "other"), (3, None)], "doc_id int, text string")
    template = make_template({"keywords": "kk", "required_fields": ["issuer"]})
    provider = ai.Canned({"amount": "12.5", "note": "", "date": "2024-01-02", "strange": 1})
    rows = {r.doc_id: r for r in ai.fill_in(extract(docs, [template]), docs, provider).withColumn("record", F.to_json("record")).collect()}
    assert rows[1].extraction_method == "template" and rows[2].extraction_method == "ai" and rows[3].extraction_method is None
    assert json.loads(rows[2].record) == {"amount": 12.5, "date": "2024-01-02"}
    assert not ai.ChatEndpoint("", "").available() and ai.json_schema()["properties"]["amount_tax"] == {"type": "number"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    template = make_template({"keywords": "kk", "template_name": "t", "required_fields": ["issuer"]})
    for n in range(2):
        (tmp_path / "in" / f"{n}.txt").write_text("kk" if n else "other")
        extract_stream(arriving_texts(spark, str(tmp_path / "in")), [template], str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert sorted((r.template_name or "", r.error or "") for r in rows) == [("", "no_template"), ("t", "")]


class FakePrograms:
    """Stands for the programs that readers call."""

    def __init__(self, monkeypatch):
        self.calls = []
        monkeypatch.setattr(readers, "_run", self)
        monkeypatch.setattr(readers, "tesseract_languages", lambda: "deu+eng")
        monkeypatch.setattr(readers.shutil, "which", lambda name: f"/bin/{name}" if name != "magick" else None)

    def __call__(self, command, given=None, timeout=180):
        self.calls.append((list(command), given))
        if "-bbox-layout" in command:
            return b'<doc><page width="1"><word xMin="1.5" yMin="2" xMax="3" yMax="4">a &amp; b</word></page><page><word xMax="9" xMin="8" yMin="1" yMax="2">c</word></page></doc>'
        return b"seen\r\ntext" if command[0] == "pdftotext" else b"%PDF-made"


AREA = {"f": 1, "l": 2, "r": 100, "x": 5, "y": 6, "W": 70, "H": 80}


def test_areas_reach_the_program(monkeypatch):
    fake = FakePrograms(monkeypatch)
    for name in ("pdftotext", "tesseract"):
        assert readers.READERS[name].read(b"%PDF-1.4", AREA) == "seen\r\ntext"
        assert fake.calls[-1][0][-16:] == ["-f", "1", "-l", "2", "-r", "100", "-x", "5", "-y", "6", "-W", "70", "-H", "80", "-", "-"]
    tesseract = next(c for c, _ in fake.calls if c[0] == "tesseract")
    assert {"--psm", "6", "--oem", "3", "preserve_interword_spaces=1", "deu+eng"} <= set(tesseract) and any(c[0] == "convert" for c, _ in fake.calls)
    fake.calls.clear()
    readers.READERS["tesseract"].read(b"\x89PNG", None)
    assert [c[0] for c, _ in fake.calls] == ["tesseract", "pdftotext"] and fake.calls[0][1] == b"\x89PNG"


def test_placed_words(spark, monkeypatch, tmp_path):
    FakePrograms(monkeypatch)
    words = readers.READERS["pdftotext"].words(b"%PDF")
    assert words == [{"page": 1, "x0": 1.5, "y0": 2.0, "x1": 3.0, "y1": 4.0, "text": "a & b"}, {"page": 2, "x0": 8.0, "y0": 1.0, "x1": 9.0, "y1": 2.0, "text": "c"}]
    monkeypatch.setitem(readers.READERS, "placed", readers.Reader("placed", lambda content, area: "t", lambda: True, words=lambda content: [{"page": 1, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "text": "w"}]))
    (tmp_path / "x.bin").write_bytes(b"1")
    rows = readers.reader_texts(readers.read_folder(spark, str(tmp_path)), ["placed", "text"], boxes=True).collect()
    assert {r.reader: r.boxes and [b.text for b in r.boxes] for r in rows} == {"placed": ["w"], "text": None}


def test_ocr_options(monkeypatch):
    import sys
    import types

    seen = {}

    def ocr(given, made, **options):
        seen.update(options)
        open(made, "wb").write(b"%PDF-" + open(given, "rb").read())
        return 0 if options.get("deskew") is not False else 3

    monkeypatch.setitem(sys.modules, "ocrmypdf", types.SimpleNamespace(ocr=ocr))
    FakePrograms(monkeypatch)
    assert readers.ocrmypdf_reader("scan", **readers.SCAN_OPTIONS).read(b"x", None) == "seen\r\ntext"
    assert seen["deskew"] is True and seen["redo_ocr"] is False and seen["progress_bar"] is False
    with pytest.raises(RuntimeError):
        readers.ocr_processed(b"x", {"deskew": False})


def test_model_readers_shape_their_results(monkeypatch):
    import types

    pages = {"pages": [{"blocks": [{"lines": [{"words": [{"value": "a"}, {"value": "b"}]}, {"words": []}]}]}]}
    assert readers.doctr_text(types.SimpleNamespace(export=lambda: pages)) == "a b\n" and readers.doctr_text(types.SimpleNamespace(render=lambda: "whole")) == "whole"
    assert readers.paddle_text([{"rec_texts": ["x", 1]}, None, [[[0], ("y", 0.9)], [[0], ()], "odd"]]) == "x\n1\ny" and readers.paddle_text(None) == ""
    page = types.SimpleNamespace(full_text_annotation=types.SimpleNamespace(text="p"))
    assert readers.vision_text(types.SimpleNamespace(responses=[types.SimpleNamespace(responses=[page, page]), page])) == "p\np\np"
    made = []
    monkeypatch.setattr(readers, "_vision_client", lambda: types.SimpleNamespace(batch_annotate_files=lambda requests: made.append(requests) or types.SimpleNamespace(responses=[page])))
    assert readers.READERS["gvision"].read(b"%PDF-", None) == "p" and made[0][0]["input_config"]["mime_type"] == "application/pdf"
    assert not readers.READERS["gvision"].available() and not readers.READERS["doctr"].available()


def test_what_was_just_read_is_remembered(monkeypatch):
    calls = []
    once = readers.remembering(lambda reader, content, area: calls.append((reader.name, content, area)) or len(calls))
    text = readers.READERS["text"]
    assert [once(text, b"a", None), once(text, b"a", None), once(text, b"a", {"x": 1}), once(text, b"b", None), once(readers.READERS["pdfium"], b"a", None)] == [1, 1, 2, 3, 4]
    monkeypatch.setattr(readers, "REMEMBERED", 1)
    assert [once(text, b"c", None), once(text, b"d", None), once(text, b"c", None)] == [5, 6, 7]


def counting(path, answers):
    """A reader's function that notes in a file what it was called with."""
    path = str(path)

    def read(content, area):
        with open(path, "a") as out:
            out.write(content.decode() + "\n")
        return answers.get(content.decode(), "")

    return read


def test_documents_go_through_readers_in_waves(spark, tmp_path, monkeypatch):
    from tabulon.plans.documents import read_documents

    (tmp_path / "in").mkdir()
    for name in ("whole", "late", "pinned", "scan", "model", "blank"):
        (tmp_path / "in" / f"{name}.pdf").write_text(name)
    (tmp_path / "in" / "plain.txt").write_text("kk 7\nROWS\nr 1\nEND")
    full, bare = "kk 1\nROWS\nr 1\nEND", "kk 2\nROWS\nEND"
    answers = {
        "quick": {"whole": full, "late": bare, "pinned": "pin 3", "model": "unknown text"}, "slow": {"late": full, "model": "other text"},
        "special": {"pinned": "pin 4"}, "ocr": {"scan": "kk 9\nROWS\nr 1\nEND"},
    }
    for name, own in answers.items():
        monkeypatch.setitem(readers.READERS, name, readers.Reader(name, counting(tmp_path / name, own), lambda: True, is_ocr=name == "ocr"))
    monkeypatch.setattr(readers, "AUTOMATIC", ("quick", "slow"))
    rows = {"parser": "lines", "start": "ROWS\n", "end": "END", "line": r"r (?P<n>\d)"}
    every = [
        make_template({"template_name": "kk", "keywords": "kk", "required_fields": ["n"], "fields": {"n": r"kk (\d)", "lines": rows}}),
        make_template({"template_name": "pin", "keywords": "pin", "required_fields": ["n"], "input_module": "special", "fields": {"n": r"pin (\d)"}}),
    ]
    found = read_documents(spark, str(tmp_path / "in"), every, last_resorts=["ocr"], provider=ai.Canned({"amount": 5}))
    got = {r.doc_id.rsplit("/", 1)[1]: (r.reader, r.error, r.extraction_method, json.loads(r.record).get("n") if r.record else None) for r in found.withColumn("record", F.to_json("record")).collect()}
    assert got == {
        "whole.pdf": ("quick", None, "template", "1"), "late.pdf": ("slow", None, "template", "1"), "pinned.pdf": ("special", None, "template", "4"), "scan.pdf": ("ocr", None, "template", "9"),
        "model.pdf": ("quick", "no_template", "ai", None), "blank.pdf": (None, "no_text", None, None), "plain.txt": ("text", None, "template", "7"),
    }
    calls = {name: sorted((tmp_path / name).read_text().split()) for name in answers}
    assert calls["slow"] == ["blank", "late", "model", "scan"] and calls["special"] == ["pinned"] and calls["ocr"] == ["blank", "model", "scan"]
    assert [calls["quick"].count(x) for x in ("whole", "late", "pinned")] == [1, 1, 1]
    one = read_documents(spark, str(tmp_path / "in"), every, reader="slow", last_resorts=[])
    assert {r.doc_id.rsplit("/", 1)[1] for r in one.where("record is not null").collect()} == {"late.pdf"}
    with pytest.raises(KeyError):
        read_documents(spark, str(tmp_path / "in"), every, reader="nothing")


def test_drafts_by_a_model():
    seen = []

    class Model(ai.Canned):
        def extract(self, text, schema):
            seen.append((text, schema))
            return self.answer

    answer = {"issuer": "X", "keywords": "Acme", "fields": {"amount": {"parser": "regex", "regex": r"Total: (\S+)"}, "bad": {"parser": "regex", "regex": "("}}}
    made = ai.draft_template(TEXT, Model(answer), issuer="Mine")
    assert made == {"issuer": "Mine", "keywords": ["Acme"], "fields": {"amount": answer["fields"]["amount"]}}
    assert "amount = 1.234,56" in seen[0][0] and TEXT in seen[0][0]
    assert ai.draft_template(TEXT, Model({"fields": None}))["keywords"] == ["Acme Ltd"]


def test_model_configuration():
    env = {"TABULON_AI_PROVIDER": "Ollama", "TABULON_AI_MODEL": "m"}
    made = ai.get_provider(ai.load_config(env))
    assert isinstance(made, ai.ChatEndpoint) and made.url == "http://localhost:11434/v1" and made.available()
    assert isinstance(ai.get_provider(ai.load_config({})), ai.Canned) and ai.load_config({**env, "TABULON_AI_BASE_URL": "http://h"}).url == "http://h"


def test_detected_tables(spark, monkeypatch, tmp_path):
    import sys

    (tmp_path / "camelot.py").write_text("""
class T:
    def __init__(self, data): self.data = data
def read_pdf(path, pages="1", flavor="lattice"):
    content = open(path, "rb").read()
    if content == b"bad": raise ValueError("x")
    return [T([["a", " b "], ["1", "2"]]), T([[pages, flavor]])]
""")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "camelot.py"))
    files = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad")), (3, None)], "doc_id int, content binary")
    blocks = [{"field": "rows", "tables": 0, "pages": "3", "unknown": 1}, {"header": False, "tables": 1, "flavor": "stream"}]
    got = {(r.doc_id, r.field): json.loads(r.j) for r in authoring.detected_tables(files, blocks).selectExpr("doc_id", "field", "to_json(records) j").collect()}
    assert got[1, "rows"] == [{"a": "1", "b": "2"}] and got[1, "lines"] == [{"col_0": "1", "col_1": "stream"}] and not any(k[0] == 2 for k in got)
    sys.modules.pop("camelot", None)
    assert authoring.detector_blocks({"flavor": "stream", "other": 2, "rules": {"1": {"table_areas": [1, 2, 3.5, 4], "columns": ""}}}) == [{"pages": "1", "table_areas": ["1,2,3.5,4"], "flavor": "stream"}]


def test_review():
    answers = iter(["", "(", r"To(\w+)", "-"])
    draft = {"keywords": ["k"], "fields": {n: {"parser": "regex", "regex": "x"} for n in ("a", "b", "c")}}
    made = authoring.review(draft, "Total", lambda shown: next(answers))
    assert made["fields"] == {"a": {"parser": "regex", "regex": "x"}, "b": {"parser": "regex", "regex": r"To(\w+)"}} and len(draft["fields"]) == 3
