"""The same extraction by Python's own engine, for templates whose patterns the JVM reads otherwise.

Runs in Arrow batches; it is also what tests compare the native expressions with.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from typing import Any

from tabulon.functions.dates import read_date
from tabulon.operators.enrich import ALIASES, UNIT_CODES
from tabulon.operators.tables import column_type
from tabulon.operators.wordboxes import TOLERANCE, area_in_points
from tabulon.sources.templates import LineRule, LinesField, Options, RegexField, StaticField, TableRule, Template

_MARKED = re.compile(r"[,.'\\s]")
_PLAIN = re.compile(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")
_NUMBER = re.compile(r"[+-]?\d+(?:[\s',.]\d+)*")


@lru_cache(maxsize=4096)
def _compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern)


@lru_cache(maxsize=4096)
def _all_compiled(patterns: tuple[str, ...]) -> tuple[re.Pattern[str], ...]:
    return tuple(map(_compiled, patterns))


@lru_cache(maxsize=4096)
def _names(patterns: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(n for p in patterns for n in _compiled(p).groupindex)


def parse_number(value: str, decimal: str) -> float:
    if decimal in (".", ",") and value.isascii() and value.replace(decimal, "", 1).isdigit():  # what most are
        return float(value if decimal == "." else value.replace(decimal, "."))
    if not _MARKED.search(value):
        return float(value)
    if value.count(decimal) > 1:
        raise ValueError(value)
    bare = re.sub(r"[\s']", "", value.replace("," if decimal == "." else ".", ""))
    return float(bare.replace(decimal, "."))


def coerce(value: str, kind: str | None, options: Options) -> Any:
    if kind == "int":
        return int(parse_number(value, options.decimal_separator)) if value else 0
    if kind == "float":
        return parse_number(value, options.decimal_separator) if value else 0.0
    if kind in ("date", "datetime"):
        return _short_date(value, options.date_formats, options.languages) if len(value) <= 40 else read_date(value, options.date_formats, options.languages)
    return value


#: Days repeat from document to document; longer values aren't kept.
_short_date = lru_cache(maxsize=20_000)(read_date)


def cell(value: str, kind: str | None, options: Options) -> Any:
    """As ``coerce``; a number that can't be read is left out, as it is in rows."""
    try:
        return coerce(value, kind, options)
    except ValueError:
        return None


def group(values: list, how: str) -> Any:
    some = [v for v in values if v]
    if not some:
        return None
    if how == "join":
        return " ".join(map(str, some))
    return {"sum": sum, "min": min, "max": max, "first": lambda v: v[0], "last": lambda v: v[-1]}[how](some)


def field(text: str, spec: RegexField, options: Options) -> Any:
    found: list[str] = []
    for p in _all_compiled(spec.patterns):
        if p.groups <= 1:
            found += p.findall(text)
    for pattern, by in spec.replace:
        found = [re.sub(pattern, by, v) for v in found]
    if spec.extract_number:
        found = [m[0] if (m := _NUMBER.search(v)) else v for v in found]
    typed = [coerce(v, spec.type, options) for v in found] if spec.type else found
    if spec.group:
        return group(typed, spec.group)
    typed = list(dict.fromkeys(v for v in typed if v is not None))
    return typed[0] if len(typed) == 1 else typed or None


def _match(patterns: tuple[re.Pattern[str], ...], line: str) -> re.Match[str] | None:
    for p in patterns:
        if m := p.search(line):
            return m
    return None


def _cells(match: re.Match[str]) -> dict[str, str]:
    return {k: v.strip() if v else "" for k, v in match.groupdict().items()}


def _merged(row: dict[str, str], match: re.Match[str]) -> dict[str, str]:
    for k, v in _cells(match).items():
        old = row.get(k, "")
        row[k] = old + ("\n" if old else "") + v
    return row


def rows(block: str, rule: LineRule) -> list[dict[str, str]]:
    first = _all_compiled(rule.first_line or (() if rule.last_line else rule.line))
    skip, last, more = _all_compiled(rule.skip_line), _all_compiled(rule.last_line), () if not rule.first_line else _all_compiled(rule.line)
    done: list[dict[str, str]] = []
    row: dict[str, str] = {}
    is_open = False
    for line in block.split("\n") if rule.line_separator == "\n" else _compiled(rule.line_separator).split(block):
        if not line.strip("\n").strip("\r") or skip and _match(skip, line):
            continue
        if m := _match(first, line):
            if row:
                done.append(row)
            row, is_open = _cells(m), True
        elif is_open and last and (m := _match(last, line)):
            done.append(_merged(row, m))
            row, is_open = {}, False
        elif is_open and more and (m := _match(more, line)):
            row = _merged(row, m)
    return [*done, row] if row else done


def blocks(text: str, rule: LineRule) -> list[str]:
    out = []
    start, end = _compiled(rule.start), _compiled(rule.end)
    while s := start.search(text):
        text = text[s.end() :]
        e = list(end.finditer(text))[-1:] if rule.end_match == "last" else [m] if (m := end.search(text)) else []
        if not e:
            break
        e = e[0]
        out.append(text[: e.start()])
        text = text[e.end() :]
    return out


def line_items(text: str, spec: LinesField, options: Options) -> list[dict[str, Any]]:
    out = []
    for rule in spec.rules:
        types = dict(rule.types)
        for block in blocks(text, rule):
            for row in rows(block, rule):
                for name, pairs in rule.replace:
                    for pattern, by in pairs:
                        if name in row:
                            row[name] = re.sub(pattern, by, row[name])
                for k, kind in types.items():
                    if k in row:
                        row[k] = cell(row[k], kind, options)
                out.append(row)
    return out


def table(text: str, rule: TableRule, options: Options) -> dict[str, Any]:
    s, e = _compiled(rule.start).search(text), _compiled(rule.end).search(text)
    if not s or not e:
        return {}
    columns: dict[str, list] = {}
    for line in _compiled(rule.line_separator).split(text[s.end() : e.start()]):
        if line.strip() and (m := _compiled(rule.body).search(line)):
            for name, value in m.groupdict().items():
                columns.setdefault(name, []).append(cell((value or "").strip(), column_type(name, rule), options))
    grouped = dict(rule.groups)
    out = {name: group(values, grouped[name]) if name in grouped else values[0] if len(values) == 1 else values for name, values in columns.items()}
    return {k: v for k, v in out.items() if v is not None}


def prepare(text: str, options: Options) -> str:
    import unicodedata

    if options.remove_whitespace:
        text = text.replace(" ", "")
    if options.remove_accents:
        text = unicodedata.normalize("NFKD", text).translate(dict.fromkeys(range(0x300, 0x363)))
    if options.lowercase:
        text = text.lower()
    for pattern, by in options.replace:
        text = re.sub(pattern, by, text)
    return text


def _number(row: Mapping[str, Any], name: str) -> float | None:
    value = row.get(name)
    if isinstance(value, str):
        return float(value) if _PLAIN.search(value.strip()) else None
    return None if value is None or isinstance(value, datetime) else float(value)


def tax_amount(subtotal: float | None, percent: float | None) -> float | None:
    """Half-up at two places on the digits that are shown."""
    if subtotal is None or percent is None:
        return None
    shown = Decimal(repr(subtotal * percent / 100)).quantize(Decimal("0.000001"), ROUND_HALF_UP)
    return float(shown.quantize(Decimal("0.01"), ROUND_HALF_UP))


@lru_cache(maxsize=1024)
def _other_names(columns: tuple[str, ...]) -> tuple[tuple[str, list[str]], ...]:
    """Canonical names with those of the columns that stand for them, where there are any."""
    every = ((c, [a for a, own in ALIASES.items() if own == c and a in columns]) for c in dict.fromkeys(ALIASES.values()))
    return tuple((c, others) for c, others in every if others)


def rename_aliases(rows: list[dict[str, Any]], columns: Sequence[str]) -> None:
    """Canonical names in place of the others; the canonical value wins, and another name stays beside one that was there first."""
    for canonical, others in _other_names(tuple(columns)):
        for row in rows:
            held = [n for n in ([canonical] if canonical in columns else []) + others if row.get(n) is not None]
            value = row[held[0]] if held else None
            if held and held[0] != canonical:
                del row[held[0]]
            if held:
                row[canonical] = value


def add_unit_codes(rows: list[dict[str, Any]]) -> None:
    for row in rows:
        if row.get("uom") is not None and row.get("unece_code") is None and (code := UNIT_CODES.get(str(row["uom"]).strip().lower())):
            row["unece_code"] = code


def apply_tax(rows: list[dict[str, Any]], taxes: list[dict[str, Any]], by_code: bool) -> None:
    """Rates for lines without one: of the last tax row of their code, else the only active rate; and the amount with it."""
    active = {p for t in taxes if (p := _number(t, "line_tax_percent")) and (_number(t, "price_subtotal") or _number(t, "line_tax_amount"))}
    single = next(iter(active)) if len(active) == 1 else None
    for row in rows:
        given = single
        if by_code and (code := row.get("line_tax_code")) is not None:
            same = [t for t in taxes if t.get("line_tax_code") is not None and str(t["line_tax_code"]) == str(code) and t.get("line_tax_percent") is not None]
            own = _number(same[-1], "line_tax_percent") if same else None
            given = own if own is not None else single
        before = _number(row, "line_tax_percent")
        amount = _number(row, "line_tax_amount")
        row["line_tax_percent"] = given if before is None else before
        row["line_tax_amount"] = tax_amount(_number(row, "price_subtotal"), given) if amount is None and before is None else amount


def compute_tax(taxes: list[dict[str, Any]]) -> None:
    for t in taxes:
        own = _number(t, "line_tax_amount")
        t["line_tax_amount"] = tax_amount(_number(t, "price_subtotal"), _number(t, "line_tax_percent")) if own is None else own


def tax_total_differs(taxes: list[dict[str, Any]], total: float | None) -> bool:
    cents = [Decimal(repr(a)).quantize(Decimal("0.01"), ROUND_HALF_UP) for t in taxes if (a := _number(t, "line_tax_amount")) is not None]
    return total is not None and sum(cents) != 0 and abs(sum(cents) - Decimal(repr(total)).quantize(Decimal("0.01"), ROUND_HALF_UP)) > Decimal("0.02")


def crop(boxes: list[Mapping[str, Any]], area: Mapping[str, float]) -> str:
    """Text of the words that overlap an area, as lines."""
    left, top, right, bottom = area_in_points(area)
    inside = [b for b in boxes if area["f"] <= b["page"] <= area["l"] and b["x1"] > left and b["x0"] < right and b["y1"] > top and b["y0"] < bottom]
    out: list[list[tuple[float, str]]] = []
    before: tuple[int, float] | None = None
    for b in sorted(inside, key=lambda b: (b["page"], b["y0"], b["x0"], b["text"])):
        if before is None or b["page"] != before[0] or abs(before[1] - b["y0"]) > TOLERANCE:
            out.append([])
        out[-1].append((b["x0"], b["text"]))
        before = b["page"], b["y0"]
    return "\n".join(" ".join(t for _, t in sorted(line)) for line in out)


def extract(raw: str, template: Template, boxes: list[Mapping[str, Any]] | None = None) -> dict[str, Any]:
    """Fields of one text, as the native plan gives them; ValueError where a number cannot be read.

    Own parsers are expressions and give nothing here.
    """
    options = template.options
    text = prepare(raw, options)
    out: dict[str, Any] = {"issuer": template.issuer, "template_name": template.name}
    rows: dict[str, tuple[list[dict[str, Any]], list[str]]] = {}
    for spec in template.fields:
        area = getattr(spec, "area", None)
        source = text if boxes is None or not area else crop(boxes, dict(area))
        if isinstance(spec, StaticField):
            value = spec.value
        elif isinstance(spec, LinesField):
            value = line_items(source, spec, options)
            rows[spec.name] = value, [n for r in spec.rules for p in (r.first_line, r.line, r.last_line) for n in _names(p)]
            value = value or ([] if spec.keep_empty else None)
        elif isinstance(spec, RegexField):
            value = field(source, spec, options)
        else:
            continue
        if value is not None and value != "":
            out[spec.name] = value
    for rule in template.tables:
        out.update(table(text, rule, options))
    for name in ("lines", "tax_lines"):
        if name in rows:
            rename_aliases(*rows[name])
    if "lines" in rows:
        add_unit_codes(rows["lines"][0])
    if {"lines", "tax_lines"} <= set(rows):
        by_code = "line_tax_code" in rows["lines"][1] and "line_tax_code" in rows["tax_lines"][1]
        apply_tax(rows["lines"][0], rows["tax_lines"][0], by_code)
    taxed = {ALIASES.get(c, c) for c in rows["tax_lines"][1]} if "tax_lines" in rows else set()
    if {"line_tax_percent", "price_subtotal"} <= taxed:
        compute_tax(rows["tax_lines"][0])
    out.setdefault("currency", options.currency)
    out["desc"] = f"Invoice from {template.issuer}"
    return out


def warnings(record: Mapping[str, Any], template: Template) -> list[str]:
    """What doesn't fit but is no error: a stated tax total that isn't its rows' sum."""
    stated = next((f for f in template.fields if isinstance(f, RegexField) and f.name == "amount_tax" and not f.group), None)
    taxes = record.get("tax_lines")
    if stated is None or not isinstance(taxes, list) or isinstance(record.get("amount_tax"), list):
        return []
    return ["tax_total"] if tax_total_differs(taxes, _number(record, "amount_tax")) else []


def lineless(record: Mapping[str, Any], template: Template) -> bool:
    """The template declares lines and the record has no list that isn't empty."""
    return template.declares_lines and not any(isinstance(v, list) and v for v in record.values())


#: An encoder for all records: one for each takes longer than encoding.
_JSON = json.JSONEncoder(ensure_ascii=False, default=lambda v: v.isoformat(sep=" ") if isinstance(v, datetime) else str(v))


def as_json(record: Mapping[str, Any]) -> str:
    return _JSON.encode(record)
