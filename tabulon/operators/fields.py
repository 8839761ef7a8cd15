"""Fields by regular expression: find, replace, take the number, type, group, drop repeats, unwrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions import dates, numbers
from tabulon.functions.binding import let
from tabulon.functions.regex_dialect import translate
from tabulon.functions.text import replace_all
from tabulon.sources.templates import Options, RegexField


def find_all(text: Column, pattern: str) -> Column:
    """All matches: the only group, "" where it took no part, or the whole match without groups."""
    p = translate(pattern)
    if p.groups > 1:  # several groups give tuples, which no field takes
        return F.array().cast("array<string>")
    return F.regexp_extract_all(text, F.lit(p.java), F.lit(p.groups))


def coerce(value: Column, kind: str | None, options: Options) -> Column:
    """A string as the type; empty numbers are zero, and null stands for what cannot be read."""
    if kind == "int":
        return F.when(value == "", F.lit(0).cast("bigint")).otherwise(numbers.parse_integer(value, options.decimal_separator))
    if kind == "float":
        return F.when(value == "", F.lit(0.0)).otherwise(numbers.parse_number(value, options.decimal_separator))
    if kind in ("date", "datetime"):
        return dates.parse_date(value, options.date_formats, languages=options.languages)
    return value


def unreadable(typed: Column, kind: str | None) -> Column:
    """Some number could not be read, which fails the document; a date that can't is only left out."""
    if kind not in ("int", "float"):
        return F.lit(False)
    return F.exists(typed, lambda x: x.isNull())


def group(values: Column, how: str, kind: str | None) -> Column:
    """One value of many: zeros, empty texts and nulls are left out first; null of none."""
    nothing = (lambda x: x != 0) if kind in ("int", "float") else (lambda x: x.isNotNull()) if kind in ("date", "datetime") else (lambda x: x != "")
    return let(F.filter(values, lambda x: x.isNotNull() & nothing(x)), lambda some: _grouped(some, how, kind))


def _grouped(some: Column, how: str, kind: str | None) -> Column:
    if how == "sum":
        zero = F.lit(0).cast("bigint") if kind == "int" else F.lit(0.0)
        total = F.aggregate(some, zero, lambda a, x: a + x)
        return F.when(F.size(some) > 0, total)
    if how == "min":
        return F.array_min(some)
    if how == "max":
        return F.array_max(some)
    if how == "first":
        return F.try_element_at(some, F.lit(1))
    if how == "last":
        return F.try_element_at(some, F.lit(-1))
    if how == "join":
        return F.when(F.size(some) > 0, F.array_join(some.cast("array<string>"), " "))
    raise ValueError(how)


def values(text: Column, field: RegexField, options: Options) -> Column:
    """All typed values of a field in order; null stands for what could not be read."""
    found: Column = F.concat(*[find_all(text, p) for p in field.patterns])
    if field.replace:
        found = F.transform(found, lambda v: replace_all(v, field.replace))
    if field.extract_number:
        found = F.transform(found, numbers.extract_number)
    return F.transform(found, lambda v: coerce(v, field.type, options)) if field.type else found


def distinct(typed: Column) -> Column:
    """First occurrences, without nulls."""
    return F.array_distinct(F.array_compact(typed))


def field_value(text: Column, field: RegexField, options: Options) -> tuple[Column, Column]:
    """``value`` (grouped) or ``values`` (distinct) of a field, with whether a number could not be read."""
    both = field_pair(text, field, options)
    return both["value"], both["broken"]


def field_pair(text: Column, field: RegexField, options: Options) -> Column:
    """struct(value, broken) of a field; the search runs once."""

    def both(typed: Column) -> Column:
        value = group(typed, field.group, field.type) if field.group else distinct(typed)
        return F.struct(value.alias("value"), unreadable(typed, field.type).alias("broken"))

    return let(values(text, field, options), both)


def single(array: Column) -> Column:
    """The only value, else null."""
    return F.when(F.size(array) == 1, array[0])


def present(fields: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]))
