"""Evaluating an expression once that others refer to often."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is evaluated once however often the body refers to it.

    Within conditional branches and higher-order functions the optimizer doesn't share equal
    subexpressions, so an extraction that is named three times would run three times. A fold over
    nothing hands the value to its last step; taking the element of a transformed array would derive
    the type of the whole body again for each row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, lambda v: body(v))


def literal_map(pairs: Mapping[str, str | int | None]) -> Column:
    """A constant map, made by one call: a call for each key and value would take longer than all the rest of a plan."""
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"map({', '.join(quoted(x) for pair in pairs.items() for x in pair)})")


def computed_columns(frame: DataFrame, columns: Sequence[Column], name: str) -> DataFrame:
    """Adds columns ``name``0, ``name``1, … that later steps read and cannot inline; those that none reads are not made.

    A random index, always 0, into an array of one keeps filters and projections off, as a generator
    would; but a generator makes all its columns whenever one of them is read.
    """
    held = lambda c: F.get(F.array(c), F.rand(0).cast("int"))
    return frame.select("*", *[held(c).alias(f"{name}{k}") for k, c in enumerate(columns)])


def computed(frame: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that later projections read and cannot inline: a one-element explode stands between."""
    return frame.select("*", F.explode(F.array(value)).alias(name))
