"""Templates: declarative rules read from YAML or JSON, checked once, as plain values."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from tabulon.functions.regex_dialect import portable, translate

logger = logging.getLogger(__name__)

GROUPS = ("sum", "min", "max", "first", "last", "join")
TYPES = ("int", "float", "date", "datetime")
REQUIRED = ("date", "amount", "invoice_number", "issuer")
AREA = ("f", "l", "r", "x", "y", "W", "H")


class TemplateError(ValueError):
    """A template that breaks the grammar."""


@dataclass(frozen=True)
class Options:
    remove_whitespace: bool = False
    remove_accents: bool = False
    lowercase: bool = False
    currency: str = "EUR"
    date_formats: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    decimal_separator: str = "."
    replace: tuple[tuple[str, str], ...] = ()
    strict_fields: bool = False
    extra_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class RegexField:
    name: str
    patterns: tuple[str, ...]
    type: str | None = None
    group: str | None = None
    replace: tuple[tuple[str, str], ...] = ()
    extract_number: bool = False
    area: tuple[tuple[str, float], ...] | None = None
    legacy: bool = False


#: Parsers besides regex, static and lines: function(text column, settings, options) giving a column.
PARSERS: dict[str, Callable] = {}


def register_parser(name: str, parser: Callable) -> None:
    """Lets templates name a parser of one's own; its column is the field's value, null where absent."""
    PARSERS[name] = parser


@dataclass(frozen=True)
class CustomField:
    name: str
    parser: str
    settings: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class StaticField:
    name: str
    value: Any


@dataclass(frozen=True)
class LineRule:
    start: str
    end: str
    line: tuple[str, ...]
    first_line: tuple[str, ...] = ()
    last_line: tuple[str, ...] = ()
    skip_line: tuple[str, ...] = ()
    end_match: str = "first"
    line_separator: str = "\n"
    types: tuple[tuple[str, str], ...] = ()
    replace: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = ()


@dataclass(frozen=True)
class LinesField:
    name: str
    rules: tuple[LineRule, ...]
    keep_empty: bool = False
    area: tuple[tuple[str, float], ...] | None = None


@dataclass(frozen=True)
class TableRule:
    start: str
    end: str
    body: str
    line_separator: str = "\n"
    types: tuple[tuple[str, str], ...] = ()
    groups: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Template:
    name: str
    issuer: str
    keywords: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    priority: int = 5
    fields: tuple[RegexField | StaticField | LinesField, ...] = ()
    tables: tuple[TableRule, ...] = ()
    options: Options = field(default_factory=Options)
    required: tuple[str, ...] = REQUIRED
    reader: str | None = None
    keyword_mode: str = "literal"

    @property
    def declares_lines(self) -> bool:
        return bool(self.tables) or any(isinstance(f, LinesField) for f in self.fields)

    def patterns(self) -> Iterable[str]:
        for f in self.fields:
            if isinstance(f, RegexField):
                yield from f.patterns
            elif isinstance(f, LinesField):
                for r in f.rules:
                    yield from (r.start, r.end, r.line_separator, *r.line, *r.first_line, *r.last_line, *r.skip_line)
        for t in self.tables:
            yield from (t.start, t.end, t.body, t.line_separator)

    @property
    def native(self) -> bool:
        """Every pattern means the same to the JVM's engine, and no block border looks behind itself."""
        if not all(map(portable, self.patterns())):
            return False
        rules = [r for f in self.fields if isinstance(f, LinesField) for r in f.rules]
        return not any(translate(p).anchored for r in rules for p in (r.start, r.end))


def _strings(value: Any) -> tuple[str, ...]:
    if value is None:
        return ()
    return tuple(map(str, value)) if isinstance(value, (list, tuple)) else (str(value),)


def _pairs(value: Any, name: str) -> tuple[tuple[str, str], ...]:
    """One pair or a list of pairs."""
    if not value:
        return ()
    pairs = value if isinstance(value[0], (list, tuple)) else [value]
    if any(len(p) != 2 for p in pairs):
        raise TemplateError(f"{name}: a replacement needs a pattern and a text")
    return tuple((str(a), str(b)) for a, b in pairs)


def _line_replacements(value: Any) -> tuple[tuple[str, tuple[tuple[str, str], ...]], ...]:
    """A map of field to pairs, or a list of such maps of one entry."""
    maps = value if isinstance(value, list) else [value or {}]
    return tuple((str(k), _pairs(v, str(k))) for m in maps for k, v in m.items())


def _area(value: Any) -> tuple[tuple[str, float], ...] | None:
    if not value:
        return None
    if missing := set(AREA) - set(value):
        raise TemplateError(f"area lacks {sorted(missing)}")
    return tuple((k, float(value[k])) for k in AREA)


def _check(pattern: str, zero_width: bool = True) -> str:
    try:
        compiled = re.compile(pattern)
    except re.error as error:
        raise TemplateError(f"{pattern!r}: {error}") from error
    if not zero_width and compiled.fullmatch(""):
        raise TemplateError(f"{pattern!r} may match nothing, so a text would never end")
    return pattern


def _line_rule(settings: Mapping[str, Any], name: str, flat: bool) -> LineRule:
    for key in ("start", "end", "line"):
        if key not in settings:
            raise TemplateError(f"{name}: lines need {key}")
    if flat and ({"replace", "line_separator"} & set(settings)):
        logger.warning("%s: replace and line_separator work in rules only and are passed over here", name)
    if settings.get("last_line") and not settings.get("first_line"):
        logger.warning("%s: last_line without first_line never gives a row", name)
    several = {k: tuple(map(_check, _strings(settings.get(k)))) for k in ("line", "first_line", "last_line", "skip_line")}
    return LineRule(
        start=_check(settings["start"], zero_width=False), end=_check(settings["end"]), end_match=settings.get("end_match", "first"),
        types=tuple((settings.get("types") or {}).items()), replace=() if flat else _line_replacements(settings.get("replace")),
        line_separator="\n" if flat else _check(str(settings.get("line_separator", "\n")), zero_width=False), **several,
    )


def _lines(name: str, settings: Mapping[str, Any], keep_empty: bool = False) -> LinesField:
    rules = settings.get("rules")
    made = [_line_rule(r, name, False) for r in rules] if rules else [_line_rule(settings, name, True)]
    return LinesField(name, tuple(made), keep_empty, _area(settings.get("area")))


def _field(name: str, spec: Any) -> RegexField | StaticField | LinesField | None:
    if isinstance(spec, Mapping):
        parser = spec.get("parser")
        if parser == "static":
            return StaticField(name, spec.get("value"))
        if parser == "lines":
            return _lines(name, spec)
        if parser == "regex":
            if "regex" not in spec:
                raise TemplateError(f"{name}: no regex")
            kind, group = spec.get("type"), spec.get("group")
            if kind is not None and kind not in TYPES:
                raise TemplateError(f"{name}: unknown type {kind}")
            if group is not None and group not in GROUPS:
                raise TemplateError(f"{name}: unknown group {group}")
            return RegexField(name, tuple(map(_check, _strings(spec["regex"]))), kind, group, _pairs(spec.get("replace"), name), bool(spec.get("extract_number")), _area(spec.get("area")))
        if parser in PARSERS:
            return CustomField(name, parser, tuple(spec.items()))
        if parser is None:
            logger.warning("%s: a field without parser is passed over", name)
            return None
        raise TemplateError(f"{name}: unknown parser {parser}")
    if name.startswith("static_"):
        return StaticField(name.replace("static_", ""), spec)
    patterns = tuple(map(_check, _strings(spec)))
    if name.startswith("sum_amount") and isinstance(spec, list):
        return RegexField(name[4:], patterns, "float", "sum", legacy=True)
    kind = "date" if name.startswith("date") or name.endswith("date") else "float" if name.startswith("amount") else None
    return RegexField(name, patterns, kind, legacy=True)


def _table(settings: Mapping[str, Any], name: str) -> TableRule:
    for key in ("start", "end", "body"):
        if key not in settings:
            raise TemplateError(f"{name}: a table needs {key}")
        _check(settings[key])
    types = dict(settings.get("types") or {})
    groups = {}
    for column, spec in (settings.get("fields") or {}).items():
        if spec.get("type"):
            types[column] = spec["type"]
        if spec.get("group"):
            groups[column] = spec["group"]
    return TableRule(settings["start"], settings["end"], settings["body"], _check(str(settings.get("line_separator", "\n")), zero_width=False), tuple(types.items()), tuple(groups.items()))


def make_template(raw: Mapping[str, Any], name: str | None = None) -> Template:
    """A checked template of one mapping; TemplateError names what is wrong."""
    name = name or str(raw.get("template_name", "template"))
    keywords = _strings(raw.get("keywords"))
    if not keywords:
        raise TemplateError(f"{name}: no keywords")
    given = dict(raw.get("options") or {})
    languages = _strings(given.get("languages"))
    if any(len(x) != 2 for x in languages):
        raise TemplateError(f"{name}: languages are two letters each")
    plain = {k: given[k] for k in ("remove_whitespace", "remove_accents", "lowercase", "currency", "decimal_separator", "strict_fields") if k in given}
    options = Options(**plain, languages=languages, date_formats=_strings(given.get("date_formats")), extra_fields=_strings(given.get("extra_fields")), replace=_pairs(given.get("replace"), name))
    fields = [f for f in (_field(k, v) for k, v in (raw.get("fields") or {}).items()) if f]
    if raw.get("lines"):
        logger.warning("%s: lines at the top level is an old form of a field", name)
        fields.append(_lines("lines", raw["lines"], keep_empty=True))
    return Template(
        name=name, issuer=str(raw.get("issuer", keywords[0])), keywords=keywords, exclude=_strings(raw.get("exclude_keywords")), priority=int(raw.get("priority", 5)),
        fields=tuple(fields), tables=tuple(_table(t, name) for t in raw.get("tables") or ()), options=options,
        required=_strings(raw.get("required_fields")) or REQUIRED, reader=raw.get("input_module"), keyword_mode=raw.get("keyword_mode", "literal"),
    )


def parse_templates(text: str, loader=json.loads) -> list[Template]:
    """Templates of a list of mappings in a string; other content gives none, bad entries are passed over."""
    found = loader(text)
    if not isinstance(found, list):
        return []
    out = []
    for k, raw in enumerate(found):
        if not isinstance(raw, Mapping):
            logger.warning("entry %d is no mapping", k)
            continue
        try:
            out.append(make_template(raw))
        except TemplateError as error:
            logger.warning("%s", error)
    return out


def read_templates(folder: str | Path) -> list[Template]:
    """Templates of all .yml, .yaml and .json files below a folder, by path; unreadable ones are passed over."""
    out = []
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yml", ".yaml", ".json")):
        try:
            text = path.read_text(encoding="utf-8")
            if path.suffix == ".json":
                raw = json.loads(text)
            else:
                import yaml

                raw = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            if not isinstance(raw, Mapping):
                raise TemplateError("no mapping")
            out.append(make_template(raw, path.name))
        except (TemplateError, ValueError, ImportError) as error:
            logger.warning("%s: %s", path, error)
        except Exception as error:  # noqa: BLE001 - a parser's own error classes
            logger.warning("%s: %s", path, error)
    return out


def built_in() -> list[Template]:
    """General templates for invoices in six languages, of the lowest priority: what states number, date and total on lines of their own."""
    return read_templates(Path(__file__).resolve().parent.parent / "templates")


def with_built_in(templates: Iterable[Template]) -> list[Template]:
    """One's own templates, and after them the general ones whose names they don't use."""
    own = list(templates)
    return own + [t for t in built_in() if t.name not in {x.name for x in own}]


def named(templates: Iterable[Template], part: str) -> list[Template]:
    """Those whose name contains a text, without regard to case; ValueError names some if none does."""
    templates = list(templates)
    found = [t for t in templates if part.lower() in t.name.lower()]
    if not found:
        raise ValueError(f"no template matches {part!r}; there are {[t.name for t in templates][:5]}")
    return found


def by_priority(templates: Iterable[Template]) -> list[Template]:
    """Highest priority first, in the given order among equals."""
    return sorted(templates, key=lambda t: -t.priority)


def renamed(template: Template, name: str) -> Template:
    return replace(template, name=name)
