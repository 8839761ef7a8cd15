"""Records as flat rows, JSON, CSV and XML."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.text import java_date_format


def cells(frame: DataFrame, date_format: str = "%Y-%m-%d") -> DataFrame:
    """Every column as a flat cell: lists and structs as JSON text, times by the format."""
    java = java_date_format(date_format) or "yyyy-MM-dd"
    out = []
    for f in frame.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c, {"timestampNTZFormat": java, "timestampFormat": java})
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, java)
        elif isinstance(f.dataType, T.VariantType):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return frame.select(*out)


def exploded(frame: DataFrame, column: str = "lines", prefix: str = "line_") -> DataFrame:
    """One row for each element of ``column``, its fields prefixed and the others repeated; no element gives one row."""
    rest = [c for c in frame.columns if c != column]
    inner = [f.name for f in frame.schema[column].dataType.elementType.fields]
    one = frame.select(*rest, F.explode_outer(column).alias("__row"))
    return one.select(*rest, *[F.col(f"__row.`{c}`").alias(c if c.startswith(prefix) else prefix + c) for c in inner])


def key_union(frame: DataFrame, column: str = "names") -> DataFrame:
    """``key`` and ``place``: every key of the rows' lists, by its least place in a list and then by name."""
    each = frame.select(F.posexplode(column).alias("at", "key"))
    return each.groupBy("key").agg(F.min("at").alias("place")).orderBy("place", "key")


def write_csv(frame: DataFrame, path: str, date_format: str = "%Y-%m-%d", explode: str | None = None, mode: str = "error") -> None:
    """A folder that exists is an error, unless ``mode`` says overwrite or append; so of the other formats."""
    flat = exploded(frame, explode) if explode else frame
    cells(flat, date_format).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(frame: DataFrame, path: str, date_format: str = "%Y-%m-%d", mode: str = "error") -> None:
    """JSON lines, a file for each partition."""
    java = java_date_format(date_format) or "yyyy-MM-dd"
    frame.write.mode(mode).option("timestampNTZFormat", java).option("timestampFormat", java).json(path)


def write_xml(frame: DataFrame, path: str, mode: str = "error") -> None:
    """``<data><item id=…>``: lists as nested items."""
    out = [F.monotonically_increasing_id().alias("_id")] if "_id" not in frame.columns else [F.col("_id")]
    for f in frame.schema.fields:
        if f.name == "_id":
            continue
        c = F.col(f"`{f.name}`")
        out.append((F.struct(c.alias("item")) if isinstance(f.dataType, T.ArrayType) else c).alias(f.name))
    frame.select(*out).write.mode(mode).format("xml").option("rootTag", "data").option("rowTag", "item").save(path)


def formatted(value: Any, date_format: str = "%Y-%m-%d") -> Any:
    """Times as text, within lists and mappings too; the value itself stays as it is."""
    if isinstance(value, (date, datetime)):
        return value.strftime(date_format)
    if isinstance(value, Mapping):
        return {k: formatted(v, date_format) for k, v in value.items()}
    return [formatted(v, date_format) for v in value] if isinstance(value, (list, tuple)) else value


def dump_json(records: Iterable[Mapping[str, Any]], path: str, date_format: str = "%Y-%m-%d") -> None:
    """One indented array, for results small enough for one file; ``-`` is the standard output."""
    text = json.dumps([formatted(r, date_format) for r in records], indent=4, ensure_ascii=False)
    if path in ("-", "/dev/stdout"):
        print(text)
    elif path == "/dev/stderr":
        import sys

        print(text, file=sys.stderr)
    else:
        target = Path(path if path.endswith(".json") else path + ".json")
        target.write_text(text, encoding="utf-8")


def explain(frame: DataFrame, required: Iterable[str], id_column: str | None = None) -> DataFrame:
    """``field``, ``value`` and ``required`` of every field of every record, required ones first; with ``id_column`` beside it each time."""
    first = list(required)
    own = [id_column] if id_column else []
    names = [*[c for c in first if c in frame.columns], *[c for c in frame.columns if c not in (*first, *own)]]
    flat = cells(frame.select(*[F.col(c).alias("__id") for c in own], *names))
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value"), F.lit(c in first).alias("required")) for c in names])
    return flat.select(*["__id" for _ in own], F.explode(rows).alias("r")).select(*[F.col("__id").alias(c) for c in own], "r.*")
