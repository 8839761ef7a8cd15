"""File names by what was extracted, and copies under them."""

from __future__ import annotations

import re
import shutil
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.text import safe_file_part


def file_name(frame: DataFrame, pattern: str) -> Column:
    """A name such as ``{date} {invoice_number}.pdf`` from a frame's columns.

    Of a list the first value counts, dates are year-month-day, signs that file systems refuse become
    underscores, and a null value leaves its place empty.
    """
    parts = []
    for text, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", pattern):
        if text:
            parts.append(F.lit(text))
        if name:
            kind, value = frame.schema[name].dataType, F.col(f"`{name}`")
            if isinstance(kind, T.ArrayType):
                kind, value = kind.elementType, F.try_element_at(value, F.lit(1))
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                value = F.date_format(value, "yyyy-MM-dd")
            parts.append(F.coalesce(safe_file_part(value.cast("string")), F.lit("")))
    return F.concat(*parts)


def place(files: Iterable[Mapping[str, str]], folder: str, move: bool = False) -> list[str]:
    """Copies or moves each ``path`` to ``folder`` under its ``target_name``; for results on the driver's machine."""
    done = []
    for file in files:
        target = Path(folder) / file["target_name"]
        (shutil.move if move else shutil.copy)(file["path"].removeprefix("file:"), target)
        done.append(str(target))
    return done
