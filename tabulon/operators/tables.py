"""Tables: named columns of the lines between a start and an end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.binding import let
from tabulon.functions.regex_dialect import CELL, FLAGS, MATCHED, translate, whole_line
from tabulon.functions.text import strip
from tabulon.operators.fields import coerce, group
from tabulon.sources.templates import Options, TableRule


def body(text: Column, rule: TableRule) -> Column:
    """Between the first start and the first end, each sought from the text's beginning; null unless both occur.

    An end before the start leaves an empty body.
    """
    s, e = (translate(p).java.removeprefix(FLAGS) for p in (rule.start, rule.end))
    through = F.length(F.regexp_extract(text, rf"{FLAGS}^(?s:.)*?(?>{s})", 0))
    until = F.length(F.regexp_extract(text, rf"{FLAGS}^((?s:.)*?)(?>{e})", 1))
    both = text.rlike(translate(rule.start).java) & text.rlike(translate(rule.end).java)
    return F.when(both, F.when(until > through, F.substring(text, through + 1, until - through)).otherwise(""))


def column_type(name: str, rule: TableRule) -> str | None:
    """The column's stated type, else date or float by its name."""
    stated = dict(rule.types).get(name)
    if stated:
        return stated
    return "date" if name.startswith("date") or name.endswith("date") else "float" if name.startswith("amount") else None


def _cell(place: int, kind: str | None, options: Options):
    return lambda row: coerce(row[place], kind, options)


def rows(text: Column, rule: TableRule) -> Column:
    """The table's rows as array<array<string>>, a stripped cell for each named group."""
    p = translate(rule.body)
    separator = rule.line_separator if rule.line_separator == "\n" else translate(rule.line_separator).java
    lines = F.filter(F.split(body(text, rule), separator), lambda l: strip(l) != "")
    marked = F.transform(lines, lambda l: F.regexp_replace(l, whole_line(p), MATCHED + CELL.join(f"${n}" for _, n in p.names)))
    return F.transform(F.filter(marked, lambda m: m.startswith(MATCHED)), lambda m: F.transform(F.split(F.substring(m, 2, 1 << 30), CELL), strip))


def columns(text: Column, rule: TableRule, options: Options, found: Column | None = None) -> dict[str, Column]:
    """Each named column's values in line order (array), or their group; null where no line fits.

    ``found`` is what :func:`rows` gives, where a column holds it already: else each column looks anew.
    """
    p = translate(rule.body)
    found = rows(text, rule) if found is None else found
    grouped = dict(rule.groups)
    out = {}
    for place, (name, _) in enumerate(p.names):
        kind = column_type(name, rule)
        cells = F.transform(found, _cell(place, kind, options))
        out[name] = group(cells, grouped[name], kind) if name in grouped else let(cells, lambda c: F.when(F.size(c) > 0, c))
    return out
