"""Text preparation and naming functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tabulon.functions.binding import let
from tabulon.functions.regex_dialect import replacement, translate

_MARKS = dict.fromkeys(range(0x300, 0x363))


#: So many texts of a batch are Python's at a time.
_TEXTS = 100


@F.arrow_udf(StringType())
def strip_accents(text: pa.Array) -> pa.Array:
    """Compatibility decomposition without combining marks; Spark has no built-in for it.

    Goes through a batch by pieces, as texts are twice as large in Python and there are thousands in a batch.
    """
    one = lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKD", t).translate(_MARKS)
    parts = [pa.array(map(one, text.slice(k, _TEXTS).to_pylist()), text.type) for k in range(0, len(text), _TEXTS)]
    return pa.concat_arrays(parts) if parts else text


_WHITE = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(value: Column) -> Column:
    """Without white space of any kind at either end; trimming by a list of signs is dear, so plain ends are looked at first."""

    def plain(v: Column) -> Column:
        """Ends from ! to ~; the last one's code is taken once, not compared with both."""
        return (v >= "!") & (v < "\x7f") & (F.abs(F.ascii(F.substring(v, -1, 1)) * 2 - (33 + 126)) <= 126 - 33)

    every = lambda v: F.when((v == "") | plain(v), v).otherwise(F.trim(v, F.lit(_WHITE)))
    return F.when(plain(value), value).otherwise(let(F.trim(value), every))


def replace_all(value: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after another."""
    for pattern, by in pairs:
        value = F.regexp_replace(value, translate(pattern).java, replacement(by))
    return value


def prepare(text: Column, remove_whitespace: bool = False, remove_accents: bool = False, lowercase: bool = False, replace: Sequence[tuple[str, str]] = ()) -> Column:
    """The text that a template's patterns see: blanks out, accents off, lower case, replacements; in this order."""
    if remove_whitespace:
        text = F.replace(text, F.lit(" "), F.lit(""))
    if remove_accents:
        text = strip_accents(text)
    if lowercase:
        text = F.lower(text)
    return replace_all(text, replace)


def clean_reader_text(text: Column) -> Column:
    """Line ends as LF, without byte-order and non-character marks."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.translate(unix, "\ufeff\ufffe", "")


def slug(value: Column, fallback: str = "template") -> Column:
    """Lower-case letters and digits with hyphens between, or the fallback."""
    plain = F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(plain == "", F.lit(fallback)).otherwise(plain)


def safe_file_part(value: Column) -> Column:
    """Without the signs that file systems refuse."""
    return F.regexp_replace(value, r'[\x00-\x1f"*/:<>?\\|]', "_")


_STRFTIME = {"d": "dd", "m": "MM", "Y": "yyyy", "y": "yy", "B": "MMMM", "b": "MMM", "H": "HH", "M": "mm", "S": "ss", "I": "hh", "p": "a", "j": "DDD", "A": "EEEE", "a": "EEE"}


def java_date_format(percent: str) -> str | None:
    """A strptime/strftime format as a date pattern, or None if it has a directive without equal."""
    out, i, literal = [], 0, ""

    def close() -> None:
        nonlocal literal
        if literal:
            letters = any(c.isalpha() or c in "'[]{}#" for c in literal)
            out.append("'" + literal.replace("'", "''") + "'" if letters else literal)
            literal = ""

    while i < len(percent):
        if percent[i] == "%" and i + 1 < len(percent):
            if percent[i + 1] == "%":
                literal += "%"
            elif percent[i + 1] in _STRFTIME:
                close()
                out.append(_STRFTIME[percent[i + 1]])
            else:
                return None
            i += 2
        else:
            literal += percent[i]
            i += 1
    close()
    return "".join(out)
