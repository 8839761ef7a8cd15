"""Drafts of templates from a sample text."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators import labels
from tabulon.operators.candidates import _AMOUNT, _DATE
from tabulon.operators.python_dialect import prepare
from tabulon.sources.templates import Options, make_template

#: What stands for a value of a kind in a drafted pattern.
VALUES = {"date": r"(\S+(?: \S+){0,2}?)", "amount": r"([\d.,]+)"}


def slug(value: str, fallback: str = "template") -> str:
    return "-".join(re.findall("[0-9a-z]+", value.lower())) or fallback


def anchor(text: str, start: int, longest: int = 30) -> str:
    """Pattern of what stands before a place on its line; white space of any width."""
    before = text[text.rfind("\n", 0, start) + 1 : start][-longest:]
    return r"\s+".join(re.escape(p) for p in before.split()) + (r"\s*" if before.strip() else "")


def field_regex(text: str, start: int, end: int, kind: str) -> str:
    """A pattern that finds the value at this place by what stands before it."""
    value = VALUES.get(kind, r"(\S+)") if kind != "date" else "(" + re.sub(r"\d+", r"\\d+", re.sub(r"[A-Za-z]+", "[A-Za-z]+", re.escape(text[start:end]).replace(r"\ ", " "))) + ")"
    return anchor(text, start) + value


def sample_fields(text: str) -> dict[str, dict[str, Any]]:
    """Suggested field specifications: first and last date, largest amount, and labelled values, which win except over those."""
    out: dict[str, dict[str, Any]] = {}
    dates = [m for m in _DATE.finditer(text)]
    amounts = [m for m in _AMOUNT.finditer(text) if not any(m.start() < d.end() and d.start() < m.end() for d in dates)]
    if dates:
        out["date"] = {"parser": "regex", "regex": field_regex(text, *dates[0].span(), "date"), "type": "date"}
    if amounts:
        digits = lambda m: float(re.sub(r"\D", "", m[0])) / 100
        best = max(amounts, key=lambda m: (digits(m), -m.start()))
        out["amount"] = {"parser": "regex", "regex": field_regex(text, *best.span(), "amount"), "type": "float"}
    for name, label, value, start, end in labels.find_in(text):
        if name in ("date", "amount") and name in out:
            continue
        spec = next(x for x in labels.LABELS if x.field == name)
        made = {"parser": "regex", "regex": rf"{re.escape(label)}[ \t]*[.:#=\-]?[ \t]*({spec.value})"}
        if name.startswith("date"):
            made["type"] = "date"
        if name.startswith("amount"):
            made["type"] = "float"
        if spec.cleanup:
            made["replace"] = [list(p) for p in spec.cleanup]
        out[name] = made
    return out


def draft_template(text: str, issuer: str | None = None) -> dict[str, Any]:
    """A template for a sample: issuer (the first line with text) as keyword, and suggested fields."""
    first = issuer or next((line.strip() for line in text.splitlines() if line.strip()), "")
    return {"issuer": first, "keywords": [first], "fields": sample_fields(text), "options": {"currency": "EUR"}}


def preview(text: str, template: Mapping[str, Any]) -> dict[str, str | None]:
    """What each regex field would find first, after its replacements."""
    made = make_template(template)
    ready = prepare(text, made.options if isinstance(made.options, Options) else Options())
    out: dict[str, str | None] = {}
    for name, spec in template["fields"].items():
        if not isinstance(spec, Mapping) or spec.get("parser") != "regex":
            continue
        patterns = spec["regex"] if isinstance(spec["regex"], list) else [spec["regex"]]
        hit = next((m for p in patterns if (m := re.search(p, ready))), None)
        value = None if hit is None else hit[1] if hit.re.groups else hit[0]
        for old, new in spec.get("replace") or ():
            value = value and re.sub(old, new, value)
        out[name] = value
    return out


def with_regex(template: Mapping[str, Any], field: str, regex: str) -> dict[str, Any]:
    """A copy whose field has another pattern."""
    spec = {**(template["fields"].get(field) or {"parser": "regex"}), "regex": regex}
    return {**template, "fields": {**template["fields"], field: spec}}


def to_yaml(template: Mapping[str, Any]) -> str:
    import yaml

    return yaml.safe_dump(dict(template), sort_keys=False, allow_unicode=True, width=1000)


def table_rules(detected: Mapping[str, Any], shared: Mapping[str, Any] | None = None) -> list[dict[str, Any]]:
    """Table detector settings (by page) as template blocks; shared settings win, and ruled tables take no columns."""
    out = []
    for page, rules in detected.items():
        for rule in rules if isinstance(rules, list) else [rules]:
            block = {"pages": str(page), **rule, **(shared or {})}
            ruled = block.get("flavor") == "lattice"
            out.append({k: v for k, v in block.items() if not (ruled and k == "columns")})
    return out


def rows_to_records(rows: list[list[str]], header: bool = True) -> list[dict[str, str]]:
    """Rows of a detected table as records: by the first row's names, or by ``col_0`` and so on."""
    if not rows:
        return []
    names = [c.strip() or f"col_{k}" for k, c in enumerate(rows[0])] if header else [f"col_{k}" for k in range(len(rows[0]))]
    return [dict(zip(names, r)) for r in (rows[1:] if header else rows)]


#: What a table detector may be told; other settings of a block are the template's own.
DETECTOR_SETTINGS = frozenset(
    "backend column_tol columns copy_text edge_tol flag_size flavor iterations joint_tol layout_kwargs line_scale line_tol pages parallel password "
    "process_background resolution row_tol shift_text split_text strip_text suppress_stdout table_areas table_regions threshold_blocksize threshold_constant".split()
)


def detected_tables(files: DataFrame, blocks: Sequence[Mapping[str, Any]], id_column: str = "doc_id", content_column: str = "content") -> DataFrame:
    """``field`` and ``records`` (VARIANT) of the tables that camelot sees in each PDF, a row for each block with rows.

    A block says its ``field`` (lines), whether a table has a ``header`` (yes), which of the ``tables``
    (all), and settings for the detector. A file that the detector fails on has none.
    """
    known = [(str(b.get("field", "lines")), bool(b.get("header", True)), b.get("tables", "all"), {k: v for k, v in b.items() if k in DETECTOR_SETTINGS}) for b in blocks]
    kind = files.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import camelot

        for batch in batches:
            at, fields, found = [], [], []
            for k, content in enumerate(batch.column(1)):
                with tempfile.NamedTemporaryFile(suffix=".pdf") as file:  # one document at a time
                    file.write(content.as_py() or b"")
                    file.flush()
                    for field, header, which, settings in known:
                        try:
                            tables = list(camelot.read_pdf(file.name, **settings))
                            chosen = tables if which == "all" else [tables[int(which)]]
                        except Exception:  # noqa: BLE001 - a file that the detector can't read has no tables
                            continue
                        rows = [r for t in chosen for r in rows_to_records([[str(c).strip() for c in row] for row in t.data], header)]
                        if rows:
                            at.append(k)
                            fields.append(field)
                            found.append(json.dumps(rows, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(fields, pa.string()), pa.array(found, pa.string())], names=[id_column, "field", "rows"])

    made = files.select(id_column, content_column).mapInArrow(run, f"`{id_column}` {kind}, field string, rows string")
    return made.select(id_column, "field", F.parse_json("rows").alias("records"))


def detector_blocks(settings: Mapping[str, Any]) -> list[dict[str, Any]]:
    """Settings exported from a table designer (``rules`` by page, and what holds for all) as blocks for :func:`detected_tables`.

    Areas given as numbers become the detector's text; empty settings are left out.
    """
    pages = settings.get("rules", settings)
    shared = {k: v for k, v in settings.items() if k != "rules" and k in DETECTOR_SETTINGS} if "rules" in settings else {}

    def text(value: Any) -> Any:
        if isinstance(value, (list, tuple)) and value and all(isinstance(x, (int, float)) for x in value):
            return [",".join(f"{x:g}" for x in value)]
        return [text(x)[0] if isinstance(x, (list, tuple)) else x for x in value] if isinstance(value, (list, tuple)) else value

    return [{k: text(v) for k, v in block.items() if v not in (None, "", [], {})} for block in table_rules(pages, shared)]


def review(template: Mapping[str, Any], text: str, ask: Callable[[str], str] = input) -> dict[str, Any]:
    """Goes through a draft's fields: an empty answer keeps one, ``-`` drops it, anything else is its new pattern; a pattern that doesn't compile is asked for again."""
    made = dict(template)
    for name in list(template["fields"]):
        while True:
            answer = ask(f"{name} [{preview(text, made).get(name)}]: ").strip()
            if not answer:
                break
            if answer == "-":
                made = {**made, "fields": {k: v for k, v in made["fields"].items() if k != name}}
                break
            try:
                re.compile(answer)
            except re.error:
                continue
            made = with_regex(made, name, answer)
            break
    return made
