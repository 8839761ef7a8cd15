"""Dates as documents print them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tabulon.functions.binding import let, literal_map
from tabulon.functions.text import java_date_format, strip

#: Names of the twelve months by language, in full and as they are cut; the names of one month are joined by bars.
MONTHS = {
    "en": "january|jan february|feb march|mar april|apr may june|jun july|jul august|aug september|sept|sep october|oct november|nov december|dec",
    "de": "januar|jänner|jan februar|feber|feb märz|maerz|mär|mrz april|apr mai juni|jun juli|jul august|aug september|sept|sep oktober|okt november|nov dezember|dez",
    "fr": "janvier|janv février|fevrier|févr|fév mars avril|avr mai juin juillet|juil août|aout septembre|sept octobre|oct novembre|nov décembre|decembre|déc",
    "nl": "januari|jan februari|feb maart|mrt april|apr mei juni|jun juli|jul augustus|aug september|sept|sep oktober|okt november|nov december|dec",
    "es": "enero|ene febrero|feb marzo|mar abril|abr mayo|may junio|jun julio|jul agosto|ago septiembre|setiembre|sept|sep octubre|oct noviembre|nov diciembre|dic",
    "it": "gennaio|gen febbraio|feb marzo|mar aprile|apr maggio|mag giugno|giu luglio|lug agosto|ago settembre|sett|set ottobre|ott novembre|nov dicembre|dic",
    "pt": "janeiro|jan fevereiro|fev março|mar abril|abr maio|mai junho|jun julho|jul agosto|ago setembro|set outubro|out novembro|nov dezembro|dez",
    "pl": "stycznia|styczeń lutego|luty marca|marzec kwietnia|kwiecień maja|maj czerwca|czerwiec lipca|lipiec sierpnia|sierpień września|wrzesień października|październik listopada|listopad grudnia|grudzień",
}

#: Year first, or day and month (month first if it can be) before a year of two or four digits; a time may follow.
_NUMERIC = r"^\d{1,4}([-/.])\d{1,2}\1\d{1,4}(?:[T ]+\d{1,2}:\d{1,2}(?::\d{1,2})?)?$"
_COMPACT = r"^(?:19|20)\d{6}$"
_WORD = "[^\\d\\s.,/-]"
#: A weekday may stand before; the day or the month's name comes first.
_DAY_FIRST = rf"^(?:{_WORD}+\.?,?\s+)?(\d{{1,2}})(?:\.|º|er|st|nd|rd|th)?[-/\s]*(?:de\s+|of\s+)?({_WORD}{{3,}})\.?,?[-/\s]*(?:de\s+|del\s+)?(\d{{4}}|\d{{2}})$"
_MONTH_FIRST = rf"^(?:{_WORD}+\.?,\s+)?({_WORD}{{3,}})\.?[-/\s]*(\d{{1,2}})(?:st|nd|rd|th)?(?:,\s*|[-/\s]+)(\d{{4}}|\d{{2}})$"
#: Two digits below this are of this century.
PIVOT = 69

_SHAPES = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": r"\p{L}+", "MMM": r"\p{L}+\.?", "EEEE": r"\p{L}+", "EEE": r"\p{L}+", "a": r"\p{L}+", "DDD": r"\d{1,3}"}


def shape(pattern: str) -> str:
    """What values of a date pattern look like; parsing others only to fail would cost far more."""

    def part(m: re.Match[str]) -> str:
        if m[0][0] == "'":
            return re.escape(m[0].strip("'")) if m[0] != "''" else "'"
        return _SHAPES.get(m[0], r"\d{1,2}") if m[0][0].isalpha() else re.escape(m[0])

    return "^" + re.sub(r"'[^']*'|([A-Za-z])\1*|[^A-Za-z']", part, pattern) + "$"


def _try(value: Column, pattern: str) -> Column:
    loose = re.sub(r"(?<![A-Za-z])(dd|MM|HH|hh|mm|ss)(?![A-Za-z])", lambda m: m[0][0], pattern)  # one digit or two
    parsed = F.when(value.rlike(shape(pattern)), F.try_to_timestamp(value, F.lit(loose)).cast("timestamp_ntz"))
    if "yy" in pattern and "yyyy" not in pattern:  # two digits from 69 on are of the last century
        parsed = F.when(F.year(parsed) >= 2000 + PIVOT, parsed - F.make_ym_interval(F.lit(100))).otherwise(parsed)
    return parsed


@lru_cache(maxsize=64)
def month_numbers(languages: tuple[str, ...] = ()) -> dict[str, int]:
    """Number of every name of a month in English and in these languages, or in all of MONTHS if none of them is known."""
    known = [x for x in languages if x in MONTHS] or list(MONTHS)
    return {name: n for language in reversed(["en", *known]) for n, names in enumerate(MONTHS[language].split(), 1) for name in names.split("|")}


def _year(digits: Column) -> Column:
    year = digits.cast("int")
    return F.when(F.length(digits) <= 2, year + F.when(year < PIVOT, 2000).otherwise(1900)).otherwise(year)


def _made(year: Column, month: Column, day: Column, parts: Column | None = None) -> Column:
    time = [F.coalesce(F.get(parts, F.lit(k)).cast("int"), F.lit(0)) if parts is not None else F.lit(0) for k in (3, 4, 5)]
    return F.try_make_timestamp_ntz(year, month.cast("int"), day.cast("int"), *time)


def _numbers(value: Column) -> Column:
    def of(p: Column) -> Column:
        year_last = F.coalesce(_made(_year(p[2]), p[0], p[1], p), _made(_year(p[2]), p[1], p[0], p))
        return F.when((F.length(p[0]) == 4) & (F.length(p[2]) <= 2), _made(p[0].cast("int"), p[1], p[2], p)).when((F.length(p[0]) <= 2) & F.length(p[2]).isin(2, 4), year_last)

    return let(F.split(value, r"[-/.\sT:]+"), of)


def _names(value: Column, languages: tuple[str, ...]) -> Column:
    numbers = literal_map(month_numbers(languages))

    def read(pattern: str, day: int, month: int) -> Column:
        part = lambda k: F.regexp_extract(value, pattern, k)
        return F.when(value.rlike(pattern), _made(_year(part(3)), F.try_element_at(numbers, F.lower(part(month))), part(day)))

    return F.coalesce(read(_DAY_FIRST, 1, 2), read(_MONTH_FIRST, 2, 1))


def parse_date(value: Column, formats: Sequence[str] = (), general: bool = True, languages: Sequence[str] = ()) -> Column:
    """The time that the first fitting format gives, as TIMESTAMP_NTZ; null where none fits.

    ``formats`` are strptime formats; one with a directive that has no equal here is passed over.
    Then come dates in digits, month first if they can be, and dates with the month's name in English
    or one of ``languages``. Year, month and day must all be printed. :func:`read_date` is the same
    in Python.
    """
    own = [p for p in map(java_date_format, formats) if p]
    if not own and not general:
        return F.lit(None).cast("timestamp_ntz")

    def of(bare: Column) -> Column:
        ways = [_try(bare, p) for p in own]
        if general:
            compact = F.when(bare.rlike(_COMPACT), _made(F.substring(bare, 1, 4).cast("int"), F.substring(bare, 5, 2), F.substring(bare, 7, 2)))
            ways += [F.when(bare.rlike(_NUMERIC), _numbers(bare)).when(bare.rlike(r"^\d+$"), compact).otherwise(_names(bare, tuple(languages)))]
        return F.coalesce(*ways)

    return let(strip(value), of)


def _at(year: str, month: int | str | None, day: str, *time: str) -> datetime | None:
    full = int(year) + (0 if len(year) > 2 else 2000 if int(year) < PIVOT else 1900)
    try:
        return None if month is None else datetime(full, int(month), int(day), *map(int, time))
    except ValueError:
        return None


def read_date(value: str, formats: Sequence[str] = (), languages: Sequence[str] = ()) -> datetime | None:
    """As :func:`parse_date`, of one text."""
    bare = value.strip()
    for form in formats:
        try:
            return datetime.strptime(bare, form)
        except ValueError:
            continue
    if re.search(_NUMERIC, bare, re.ASCII):
        a, b, c, *time = re.split(r"[-/.\sT:]+", bare)
        if len(a) == 4 and len(c) <= 2:
            return _at(a, b, c, *time)
        return (_at(c, a, b, *time) or _at(c, b, a, *time)) if len(a) <= 2 and len(c) in (2, 4) else None
    if re.search(r"^\d+$", bare, re.ASCII):
        return _at(bare[:4], bare[4:6], bare[6:]) if re.search(_COMPACT, bare) else None
    numbers = month_numbers(tuple(languages))
    for pattern, day, month in ((_DAY_FIRST, 1, 2), (_MONTH_FIRST, 2, 1)):
        if (m := re.search(pattern, bare, re.ASCII)) and (found := _at(m[3], numbers.get(m[month].lower()), m[day])):
            return found
    return None


@F.pandas_udf(TimestampNTZType())
def parse_date_fuzzy(value: pd.Series) -> pd.Series:
    """What a fuzzy parser reads in values that no format fits; missing parts give null.

    A function for whole columns: the engine's own fields are arrays, in which no Python function runs.
    """
    try:
        from dateutil import parser
    except ImportError:
        return pd.Series([pd.NaT] * len(value))

    def one(text: str | None) -> datetime | None:
        if not text or not text.strip():
            return None
        try:
            a = parser.parse(text, default=datetime(2000, 1, 1))
            b = parser.parse(text, default=datetime(2001, 2, 2))
        except (ValueError, OverflowError):
            return None
        return a.replace(tzinfo=None) if a == b else None

    return value.map(one).astype("datetime64[us]")
