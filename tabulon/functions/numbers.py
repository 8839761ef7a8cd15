"""Numbers as documents print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
_FIRST = r"(?U)[+-]?\d+(?:[\s',.]\d+)*"


def to_double(value: Column) -> Column:
    """A number in plain notation, blanks around it allowed; else null."""
    bare = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when(bare.rlike(_PLAIN), bare.try_cast("double"))


def parse_number(value: Column, decimal: str = ".") -> Column:
    """A printed number with this decimal mark; null where none can be read.

    Text without marks, apostrophes and blanks is read as it stands. Otherwise thousands marks,
    blanks and apostrophes go. Two decimal marks are an error (null).
    """
    thousands = "," if decimal == "." else "."
    marks = F.length(value) - F.length(F.replace(value, F.lit(decimal), F.lit("")))
    bare = F.regexp_replace(F.replace(value, F.lit(thousands), F.lit("")), r"(?U)[\s']", "")
    point = F.replace(bare, F.lit(decimal), F.lit(".")) if decimal != "." else bare
    usual = value.rlike(rf"^[0-9]{{1,15}}(?:[{decimal}][0-9]{{1,15}})?$")  # what most cells are needs one look
    quick = value if decimal == "." else F.replace(value, F.lit(decimal), F.lit("."))
    return F.when(usual, quick.try_cast("double")).when(~value.rlike(r"[,.'\\s]"), to_double(value)).when(marks <= 1, to_double(point))


def parse_integer(value: Column, decimal: str = ".") -> Column:
    """As parse_number, cut toward zero."""
    number = parse_number(value, decimal)
    cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("bigint")
    return F.when(value.rlike("^[0-9]{1,15}$"), value.try_cast("bigint")).otherwise(cut)  # exact as a double


def extract_number(value: Column) -> Column:
    """The first thing that looks like a number, or the value itself."""
    return F.coalesce(F.nullif(F.regexp_extract(value, _FIRST, 0), F.lit("")), value)


def loose_amount(raw: Column) -> Column:
    """An amount whose last mark is its decimal one; only blanks (U+0020) are dropped, other white space fails."""
    value = F.replace(raw, F.lit(" "), F.lit(""))
    reverse = F.reverse(value)
    comma, point = F.instr(reverse, ","), F.instr(reverse, ".")
    comma_last = (comma > 0) & ((point == 0) | (comma < point))
    european = F.replace(F.replace(value, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.when(comma_last, european).otherwise(F.replace(value, F.lit(","), F.lit("")))
    return F.when(plain.rlike(_PLAIN), plain.try_cast("double"))


def round_cents(value: Column) -> Column:
    """Half-up at two places on the decimal digits that are shown, so that engines agree."""
    return F.round(value.cast("decimal(20,6)"), 2).cast("double")
