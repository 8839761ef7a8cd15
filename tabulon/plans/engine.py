"""The extraction plan: match, prepare, extract, enrich, validate; one pass over the documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.binding import computed, computed_columns, let
from tabulon.functions.text import prepare
from tabulon.operators import enrich, fields, lines, matching, tables, validate, wordboxes
from tabulon.sources.templates import PARSERS, CustomField, LinesField, RegexField, StaticField, Template, TemplateError, by_priority, read_templates


@dataclass
class Compiled:
    """A template's raw columns, each to be evaluated once, and how they become fields."""

    template: Template
    raw: list[Column]
    at: dict[str, int]
    searched: set[str]
    several: set[str]
    line_columns: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return list(self.at)

    def struct(self) -> Column:
        return F.struct(*[c.alias(f"c{k}") for k, c in enumerate(self.raw)])

    def finish(self, s: Column | Mapping[str, Column]) -> tuple[dict[str, Column], Column]:
        """Fields by name, null where absent, and whether a number could not be read; ``s`` is the evaluated struct, or its fields."""
        out: dict[str, Column] = {}
        broken = F.lit(False)
        for name, k in self.at.items():
            value = s[f"c{k}"]
            if name in self.searched:
                broken = broken | value["broken"]
                value = value["value"]
                if name in self.several:
                    value = F.when((F.size(value) > 1) | (F.size(value) == 1) & (value[0].cast("string") != ""), value)
                else:
                    value = F.when(value.cast("string") != "", value)
            out[name] = value
        currency = F.lit(self.template.options.currency)
        if "currency" not in out:
            out["currency"] = currency
        elif "currency" in self.several:
            out["currency"] = F.coalesce(out["currency"], F.array(currency))
        else:
            out["currency"] = F.coalesce(out["currency"], currency)
        out["desc"] = F.lit(f"Invoice from {self.template.issuer}")
        return out, broken


def _literal(value) -> Column:
    if isinstance(value, (list, dict, tuple)):
        import json

        return F.parse_json(F.lit(json.dumps(value, default=str)))
    return F.lit(value)


def _ready(template: Template, text: Column) -> Column:
    options = template.options
    return prepare(text, options.remove_whitespace, options.remove_accents, options.lowercase, options.replace)


def _staged(frame: DataFrame, template: Template, text: Column, name: str) -> DataFrame:
    """Adds what Python has to make of a text before expressions can go on: the prepared text."""
    made = _ready(template, F.when(matching.matches(text, template), text))
    return computed(frame.withColumn(name + "_", made), F.col(name + "_"), name).drop(name + "_")


def compile_template(template: Template, text: Column, prepared: bool = False, boxes: Column | None = None, table_rows: Sequence[Column] = ()) -> Compiled:
    """Native expressions for every field of a template; constants stay literals, so that patterns are compiled once.

    ``prepared`` says that the text has gone through the template's preparation. A field with an area
    sees what the word ``boxes`` show there, unprepared; without boxes it sees the text. ``table_rows``
    are columns that hold the tables' rows already.
    """
    options = template.options
    ready = text if prepared else _ready(template, text)
    out: dict[str, Column] = {"issuer": F.lit(template.issuer), "template_name": F.lit(template.name)}
    searched: set[str] = set()
    several: set[str] = set()
    line_columns: dict[str, list[str]] = {}
    units: set[str] = set()
    for spec in template.fields:
        area = getattr(spec, "area", None)
        source = ready if boxes is None or not area else wordboxes.crop(boxes, dict(area))
        if isinstance(spec, StaticField):
            out[spec.name] = _literal(spec.value)
        elif isinstance(spec, CustomField):
            out[spec.name] = PARSERS[spec.parser](source, dict(spec.settings), options)
        elif isinstance(spec, LinesField):
            columns = list(dict.fromkeys(c for r in spec.rules for c in lines.names(r)))
            typed = any("uom" in (dict(r.types) | dict(r.replace)) for r in spec.rules)
            coded = spec.name == "lines" and "uom" in columns and not typed and not {"unece_code", *enrich.ALIASES} & set(columns)
            out[spec.name] = lines.line_items(source, spec, options, {"unece_code": ("uom", enrich.stripped_unit_code)} if coded else None)
            line_columns[spec.name] = columns + (["unece_code"] if coded else [])
            if coded:
                units.add(spec.name)
        elif isinstance(spec, RegexField):
            out[spec.name] = fields.field_pair(source, spec, options)
            searched.add(spec.name)
            if not spec.group:
                several.add(spec.name)
    for rule, found in zip(template.tables, table_rows or [None] * len(template.tables)):
        for name, value in tables.columns(ready, rule, options, found).items():
            out[name] = value
            searched.discard(name)
            several = several - {name} if name in dict(rule.groups) else several | {name}
    for name in ("lines", "tax_lines"):
        if name in line_columns:
            out[name], line_columns[name] = enrich.rename_aliases(out[name], line_columns[name])
    if "lines" in line_columns and "lines" not in units:
        out["lines"], line_columns["lines"] = enrich.with_unit_codes(out["lines"], line_columns["lines"])
    if {"lines", "tax_lines"} <= set(line_columns):
        out["lines"], line_columns["lines"] = enrich.apply_tax(out["lines"], line_columns["lines"], out["tax_lines"], line_columns["tax_lines"])
    if "tax_lines" in line_columns:
        out["tax_lines"], line_columns["tax_lines"] = enrich.compute_tax(out["tax_lines"], line_columns["tax_lines"])
    empty = {f.name for f in template.fields if isinstance(f, LinesField) and f.keep_empty}
    for name in line_columns:
        if name not in empty:
            out[name] = let(out[name], lambda rows: F.when(F.size(rows) > 0, rows))
    return Compiled(template, list(out.values()), {n: k for k, n in enumerate(out)}, searched, several, line_columns)


def extract_wide(docs: DataFrame, template: Template, text_column: str = "text") -> DataFrame:
    """Matching documents with a column for each field: the value where there is one, else null.

    A field with several distinct values has them in ``<field>_all``. ``error`` is null, or number,
    missing or strict_fields; ``missing`` lists required fields that are not there.
    """
    text = F.col(text_column)
    matched = docs.where(matching.matches(text, template))
    staged = template.options.remove_accents
    if staged:
        matched = _staged(matched, template, text, "__ready")
    boxes = F.col("boxes") if "boxes" in docs.columns else None
    ready = F.col("__ready") if staged else _ready(template, text)
    held = [f"__rows{k}" for k in range(len(template.tables))]
    matched = computed_columns(matched, [tables.rows(ready, rule) for rule in template.tables], "__rows")
    compiled = compile_template(template, F.col("__ready") if staged else text, staged, boxes, [F.col(c) for c in held])
    found = computed_columns(matched, compiled.raw, "__found")
    made, broken = compiled.finish({f"c{k}": F.col(f"__found{k}") for k in range(len(compiled.raw))})
    columns: dict[str, Column] = {}
    for name, value in made.items():
        if name in compiled.several:
            columns[name] = fields.single(value)
            columns[f"{name}_all"] = value
        else:
            columns[name] = value
    ids = [c for c in docs.columns if c not in (text_column, "boxes") and c not in columns]
    have = F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(n)) for n, v in made.items()]))
    odd = F.size(validate.unknown_present(have, template, list(made))) > 0
    lacking = validate.missing(have, template.required)
    error = F.when(broken, "number").when(F.lit(template.options.strict_fields) & odd, "strict_fields").when(F.size(lacking) > 0, "missing")
    return found.select(*ids, *[v.alias(n) for n, v in columns.items()], lacking.alias("missing"), error.alias("error"))


def record(template: Template, text: Column, staged: Column | None = None, boxes: Column | None = None) -> Column:
    """struct(template_name, record VARIANT, names, missing, unknown, error, lineless, warnings) of one template over a text.

    ``staged`` is what :func:`_staged` added for a template that needs it.
    """
    c = compile_template(template, text if staged is None else staged, staged is not None, boxes)
    return let(c.struct(), lambda s: _record_of(c, s))


def _record_of(c: Compiled, s: Column) -> Column:
    made, broken = c.finish(s)
    cells = []
    for name, value in made.items():
        if name in c.line_columns:
            boxed = F.to_variant_object(value)
        elif name in c.several:
            boxed = F.when(F.size(value) == 1, value[0].cast("variant")).otherwise(value.cast("variant"))
        else:
            boxed = value.cast("variant")
        cells += [F.lit(name), F.when(value.isNotNull(), boxed)]
    kept = F.map_filter(F.create_map(*cells), lambda k, v: v.isNotNull())
    lineless, warnings = _lineless(c, made), _warnings(c, made)
    return let(kept, lambda m: _finished(c.template, F.to_variant_object(m), F.map_keys(m), broken, lineless, warnings, list(made)))


def _lineless(c: Compiled, made: dict[str, Column]) -> Column:
    """The template declares lines and the record has no list that isn't empty."""
    if not c.template.declares_lines:
        return F.lit(False)
    some = F.lit(False)
    for name in c.line_columns:
        some = some | F.coalesce(F.size(made[name]) > 0, F.lit(False))
    for name in c.several:
        some = some | F.coalesce(F.size(made[name]) > 1, F.lit(False))
    return ~some


def _warnings(c: Compiled, made: dict[str, Column]) -> Column:
    if "tax_lines" not in c.line_columns or "amount_tax" not in c.several:
        return F.array().cast("array<string>")
    total = fields.single(made["amount_tax"]).try_cast("double")
    off = enrich.tax_total_differs(made["tax_lines"], c.line_columns["tax_lines"], total)
    return F.array_compact(F.array(F.when(off, F.lit("tax_total"))))


def _finished(template: Template, made: Column, names: Column, broken: Column, lineless: Column, warnings: Column, every: Sequence[str]) -> Column:
    def done(of: Column) -> Column:
        error = F.when(broken, "number").when(F.lit(template.options.strict_fields) & (F.size(of["odd"]) > 0), "strict_fields").when(F.size(of["lacking"]) > 0, "missing")
        return F.struct(
            F.lit(template.name).alias("template_name"), made.alias("record"), names.alias("names"), of["lacking"].alias("missing"), of["odd"].alias("unknown"),
            error.alias("error"), lineless.alias("lineless"), warnings.alias("warnings"),
        )

    return let(F.struct(validate.missing(names, template.required).alias("lacking"), validate.unknown_present(names, template, every).alias("odd")), done)


_FOUND = T.StructType([
    T.StructField("json", T.StringType()), *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("names", "missing", "unknown", "warnings")],
    T.StructField("error", T.StringType()), T.StructField("lineless", T.BooleanType()),
])


def _listed(boxes: pa.Array) -> list[list[dict] | None]:
    """As to_pylist, a field at a time: a call for each value takes longer than what is done with it."""
    if boxes.null_count == len(boxes):
        return [None] * len(boxes)
    each = boxes.values
    if each.null_count:
        return boxes.to_pylist()
    names = [f.name for f in each.type]
    dicts = [dict(zip(names, row)) for row in zip(*[each.field(n).to_pylist() for n in names])]
    at = boxes.offsets.to_pylist()
    return [dicts[a:b] if there else None for a, b, there in zip(at, at[1:], boxes.is_valid().to_pylist())]


def _by_python(text: Column, which: Column, templates: Mapping[int, Template], boxes: Column | None) -> Column:
    """What the Python dialect makes of each text by the template of its number; one function for all templates, null for others' texts."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(_FOUND)
    if not any(getattr(f, "area", None) for t in templates.values() for f in t.fields):
        boxes = None

    @F.arrow_udf(_FOUND)
    def run(texts: pa.Array, numbers: pa.Array, words: pa.Array) -> pa.Array:
        from tabulon.operators import python_dialect

        out = {f.name: [] for f in kind}
        absent, known = [], {}

        def add(**values) -> None:
            absent.append(not values)
            for name, held in out.items():
                held.append(values.get(name))

        for raw, k, own in zip(texts.to_pylist(), numbers.to_pylist(), _listed(words)):
            if raw is None or k not in templates:
                add()
                continue
            template = templates[k]
            try:
                made = python_dialect.extract(raw, template, own)
            except ValueError:
                add(names=[], missing=[], unknown=[], warnings=[], error="number", lineless=template.declares_lines)
                continue
            names = list(made)
            if (key := (k, *names)) not in known:
                odd = list(validate.unknown(names, extra=template.options.extra_fields))
                lacking = [n for n in dict.fromkeys(template.required) if n not in made]
                known[key] = odd, lacking, "strict_fields" if odd and template.options.strict_fields else "missing" if lacking else None
            odd, lacking, error = known[key]
            add(
                json=python_dialect.as_json(made), names=names, missing=lacking, unknown=odd, error=error,
                warnings=python_dialect.warnings(made, template), lineless=python_dialect.lineless(made, template),
            )
        return pa.StructArray.from_arrays([pa.array(out[f.name], f.type) for f in kind], fields=list(kind), mask=pa.array(absent, pa.bool_()))

    nothing = F.lit(None).cast("array<struct<page:int,x0:double,y0:double,x1:double,y1:double,text:string>>")
    return run(text, which, nothing if boxes is None else boxes)


def _from_python(name: Column, found: Column) -> Column:
    return F.struct(
        name.alias("template_name"), F.try_parse_json(found["json"]).alias("record"), found["names"].alias("names"), found["missing"].alias("missing"),
        found["unknown"].alias("unknown"), found["error"].alias("error"), found["lineless"].alias("lineless"), found["warnings"].alias("warnings"),
    )


#: From so many templates on the Python dialect extracts all: planning takes seconds for each template that is compiled.
MANY_TEMPLATES = 12


def goes_python(template: Template, engine: str, n: int) -> bool:
    """Whether a template of ``n`` is left to the Python dialect; own parsers need the native plan."""
    own = any(isinstance(f, CustomField) for f in template.fields)
    if own and not template.native:
        raise TemplateError(f"{template.name}: its patterns need the Python dialect, in which own parsers can't run")
    return not own and (not template.native or engine == "python" or engine == "auto" and n >= MANY_TEMPLATES)


def extract(docs: DataFrame, templates: Sequence[Template], text_column: str = "text", engine: str = "auto") -> DataFrame:
    """Every document with its template's record, in one scan and without a shuffle.

    Adds ``template_name``, ``record`` (VARIANT), ``names``, ``missing``, ``unknown``, ``error``
    (no_template, number, strict_fields, missing or null), ``lineless`` and ``warnings``. The record
    is null where there is an error. Without templates every document has none.

    ``engine``: "native" compiles each template to expressions and leaves those that have no equal to
    the Python dialect, "python" leaves it all, "auto" those and all sets of MANY_TEMPLATES and more.
    Both give the same records, but that Python's hold dates as text.
    """
    if engine not in ("auto", "native", "python"):
        raise ValueError(f"unknown engine {engine!r}")
    order = by_priority(templates)
    matched = matching.match(docs, order, text_column)
    boxes = F.col("boxes") if "boxes" in docs.columns else None
    text, index = F.col(text_column), F.col("template_index")
    python = {k: t for k, t in enumerate(order) if goes_python(t, engine, len(order))}
    if python:
        matched = computed(matched, _by_python(F.when(index.isin(list(python)), text), index, python, boxes), "__python")
    chosen = None
    for k, t in enumerate(order):
        if k in python:
            continue
        needs = t.options.remove_accents
        if needs:
            matched = _staged(matched, t, text, f"__staged{k}")
        one = record(t, text, F.col(f"__staged{k}") if needs else None, boxes)
        chosen = F.when(index == k, one) if chosen is None else chosen.when(index == k, one)
    if python:
        names = F.create_map(*[F.lit(x) for k, t in python.items() for x in (k, t.name)])
        by_name = _from_python(F.try_element_at(names, index), F.col("__python"))
        chosen = F.when(index.isin(list(python)), by_name) if chosen is None else chosen.when(index.isin(list(python)), by_name)
    if chosen is None:
        nothing = "struct<template_name:string,record:variant,names:array<string>,missing:array<string>,unknown:array<string>,error:string,lineless:boolean,warnings:array<string>>"
        chosen = F.lit(None).cast(nothing)
    out = computed(matched, chosen, "__found").select(*docs.columns, "__found.*")
    error = F.when(F.col("template_name").isNull(), "no_template").otherwise(F.col("error"))
    out = out.withColumn("error", error).withColumn("record", F.when(F.col("error").isNull(), F.col("record")))
    for plugin in PLUGINS.values():
        out = plugin(out)
    return out


#: Steps after extraction: function(result frame) giving a frame with the same columns at least.
PLUGINS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_plugin(name: str, plugin: Callable[[DataFrame], DataFrame]) -> None:
    PLUGINS[name] = plugin


class Extractor:
    """A set of templates to extract with."""

    def __init__(self, templates: Sequence[Template] = ()) -> None:
        self.templates = list(templates)

    def read_templates(self, folder: str) -> None:
        """Adds a folder's templates; those that were there come first among equal priorities."""
        self.templates += read_templates(folder)

    def extract(self, docs: DataFrame, text_column: str = "text", engine: str = "auto") -> DataFrame:
        return extract(docs, self.templates, text_column, engine)
