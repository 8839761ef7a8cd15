"""Line items: blocks between borders, and rows of first, further and last lines."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.binding import let
from tabulon.functions.regex_dialect import CELL, FLAGS, MATCHED, at_start, line_form, literal, spaceless, translate, whole_line
from tabulon.functions.text import replace_all, strip
from tabulon.operators.fields import coerce
from tabulon.sources.templates import LineRule, LinesField, Options


#: Further columns by name: the column that each is made of, and how.
Derived = Mapping[str, tuple[str, Callable[[Column], Column]]]


def blocks(text: Column, rule: LineRule) -> Column:
    """Texts between a start and the first end after it, again and again; or up to the last end, once."""
    start, end = translate(rule.start), translate(rule.end)
    s, e = start.java.removeprefix(FLAGS), end.java.removeprefix(FLAGS)
    if rule.end_match != "last":
        return F.regexp_extract_all(text, F.lit(rf"{FLAGS}(?>{s})((?s:.)*?)(?:{e})"), F.lit(start.groups + 1))
    if literal(rule.start) and literal(rule.end):
        return F.regexp_extract_all(text, F.lit(rf"{FLAGS}^(?s:.)*?(?>{s})((?s:.)*){e}"), F.lit(1))
    rest = F.regexp_extract(text, rf"{FLAGS}^(?s:.)*?(?>{s})((?s:.)*)$", start.groups + 1)
    ends = F.regexp_extract_all(rest, F.lit(end.java), F.lit(0))
    tail = F.length(F.element_at(F.split(rest, end.java), -1)) + F.length(F.element_at(ends, -1))
    return F.when(text.rlike(start.java) & (F.size(ends) > 0), F.array(F.left(rest, F.length(rest) - tail))).otherwise(F.array().cast("array<string>"))


def _hit(line: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | line.rlike(translate(p).java)
    return out


def names(rule: LineRule) -> list[str]:
    """Column names in order of first use."""
    seen: dict[str, None] = {}
    for p in (*rule.first_line, *rule.line, *rule.last_line):
        seen.update(dict.fromkeys(n for n, _ in translate(p).names))
    return list(seen)


def _row(line: Column, patterns: Sequence[str], columns: Sequence[str], before: Column | None) -> Column:
    """The row that the first pattern that fits makes of a line, added to the row before it if there is one."""

    def of(pattern: str) -> Column:
        p = translate(pattern)
        own = dict(p.names)
        groups = F.split(F.regexp_replace(line, whole_line(p), CELL.join(f"${n}" for n in own.values())), CELL)
        return let(groups, lambda found: cells_of(own, found))

    def cells_of(own: dict[str, int], found: Column) -> Column:
        place = {c: k for k, c in enumerate(own)}
        cells = []
        for c in columns:
            old = before[c] if before is not None else F.lit(None).cast("string")
            if c not in own:
                cells.append(old.alias(c))
                continue
            new = strip(found[place[c]])
            if before is not None:
                kept = F.coalesce(old, F.lit(""))
                new = F.concat(kept, F.when(kept != "", "\n").otherwise(""), new)
            cells.append(new.alias(c))
        return F.struct(*cells)

    out = of(patterns[-1])
    for pattern in reversed(patterns[:-1]):
        out = F.when(line.rlike(translate(pattern).java), of(pattern)).otherwise(out)
    return out


def _split(block: Column, rule: LineRule) -> Column:
    return F.split(block, rule.line_separator if rule.line_separator == "\n" else translate(rule.line_separator).java)


def _lines(block: Column, rule: LineRule) -> Column:
    """The block's lines that aren't blank and aren't skipped."""
    return F.filter(_split(block, rule), lambda l: _printed(l) & ~_hit(l, rule.skip_line))


def _printed(line: Column) -> Column:
    """The line isn't blank; one that begins above the line ends' signs has no need to be looked through."""
    return (line >= "\x0e") | (F.translate(line, "\r\n", "") != "")


def simple(rule: LineRule) -> bool:
    """Every line that fits the only pattern is a row."""
    return not rule.first_line and not rule.last_line and len(rule.line) == 1


def cells(block: Column, rule: LineRule) -> Column:
    """Rows of a simple rule's block as array<array<string>>, a cell for each group: one pass finds the lines that fit and takes them apart."""
    p = translate(rule.line[0])
    if in_one(rule):
        found = F.regexp_extract_all(_marked(block, rule), F.lit(f"(?dm)^{MATCHED}{CELL}(.*)$" if p.names else f"(?dm)^{MATCHED}()$"), F.lit(1))
        return F.transform(found, lambda m: F.split(m, CELL))
    marked = F.transform(_lines(block, rule), lambda l: F.regexp_replace(l, whole_line(p), MATCHED + CELL.join(f"${n}" for _, n in p.names)))
    return F.transform(F.filter(marked, lambda m: m.startswith(MATCHED)), lambda m: F.split(F.substring(m, 2, 1 << 30), CELL))


def _bare(name: str, rule: LineRule) -> bool:
    """Whether a simple rule's cell needs no stripping."""
    return name in spaceless(rule.line[0])


def _stripped(cell: Column, name: str, rule: LineRule) -> Column:
    return cell if _bare(name, rule) else strip(cell)


def _marks(rule: LineRule) -> list[str]:
    """A rule's patterns in the order in which a line is tried."""
    return [*rule.first_line, *rule.last_line, *rule.line]


def in_one(rule: LineRule) -> bool:
    """Whether a block's lines can be found and taken apart by a pass over the whole block, which looks at no line by itself."""
    wanted = (*_marks(rule), *rule.skip_line)
    return rule.line_separator == "\n" and bool(rule.line) and bool(rule.first_line or not rule.last_line) and all(line_form(p) is not None for p in wanted)


def _within(pattern: str) -> str:
    """From a line's start to the end of the pattern's first match in it."""
    return f"{'' if at_start(pattern) else '.*?'}(?:{line_form(pattern)})"


def _marked(block: Column, rule: LineRule) -> Column:
    """The block with every line that a pattern fits taken apart; other lines stay.

    Such a line is MATCHED, then for each pattern a CELL and a sign if it is the one that fits, then a
    CELL and what it holds for each named group of all patterns. A simple rule's needs no sign.
    """
    skipped = "".join(f"(?!{_within(p)})" for p in rule.skip_line)
    signs, held, ways, group = [], [], [], 0
    for pattern in _marks(rule):
        held += [group + n for _, n in translate(pattern).names]
        group += translate(pattern).groups
        if not simple(rule):  # taken last: what a look at other signs has taken stays when the way fails
            group += 1
            signs.append(group)
        ways.append(_within(pattern) + (".*" if simple(rule) else ".*(?<=(.))"))
    guard = rf"(?!{MATCHED}|\r*$)" if rule.first_line else r"(?!\r*$)"
    return F.regexp_replace(block, f"(?dUm)^{guard}{skipped}(?:{'|'.join(ways)})$", MATCHED + "".join(f"{CELL}${n}" for n in (*signs, *held)))


def _rows_in_one(block: Column, rule: LineRule) -> Column:
    """As :func:`rows`, by one pass over the block; a row is what lies between two first lines, up to a last line."""
    patterns, marked = _marks(rule), _marked(block, rule)
    firsts, lasts, n = len(rule.first_line), len(rule.first_line) + len(rule.last_line), len(patterns)
    places: dict[str, list[tuple[int, int]]] = {}  # column: number of the pattern, place of the cell
    bare: dict[str, bool] = {}
    at = n
    for k, p in enumerate(patterns):
        for c, _ in translate(p).names:
            places.setdefault(c, []).append((k, at))
            bare[c] = bare.get(c, True) and c in spaceless(p)
            at += 1

    def stripped(value: Column, column: str) -> Column:
        return value if bare[column] else let(value, strip)

    def of_line(line: Column) -> Column:
        return let(F.split(line, CELL), lambda parts: F.struct(*[of_parts(parts, c).alias(c) for c in places]))

    def of_parts(parts: Column, column: str) -> Column:
        own = places[column]
        value = stripped(F.concat(*[parts[at] for _, at in own]) if len(own) > 1 else parts[own[0][1]], column)
        return value if len(own) == n else F.when(reduce(Column.__or__, [parts[k] != "" for k, _ in own]), value)

    def of_row(row: Column, column: str) -> Column:
        own = places[column]
        found = "|".join(f"{'^' if k < firsts else MATCHED}{CELL}{{{k + 1}}}(?!{CELL})(?:[^{CELL}\n]*{CELL}){{{at - k}}}" for k, at in own)
        pattern = f"(?:{found})([^{CELL}\n]*)"
        kinds = {(k >= firsts) + (k >= lasts) for k, _ in own}
        if kinds not in ({0}, {1}):
            values = F.regexp_extract_all(row, F.lit(pattern), F.lit(1))
            return let(values if bare[column] else F.transform(values, strip), joined)
        value = stripped(F.regexp_extract(row, pattern, 1), column)
        return value if kinds == {0} and len(own) == firsts else F.when(row.rlike(found), value)

    def joined(values: Column) -> Column:
        """As a row grows: an end of line before a value if there is something already."""
        text = F.array_join(values, "\n")
        return F.when(F.size(values) > 0, F.when(text.startswith("\n"), F.regexp_replace(text, "^\n+", "")).otherwise(text))

    if not rule.first_line:
        return F.transform(F.regexp_extract_all(marked, F.lit(f"(?dm)^{MATCHED}{CELL}(.*)$"), F.lit(1)), of_line)
    each = F.slice(F.split(marked, f"{MATCHED}(?={CELL}{{1,{firsts}}}[^{CELL}])"), 2, 1 << 30)
    until = f"^[^{MATCHED}]*(?:{MATCHED}{CELL}{{{lasts + 1},{n}}}[^{CELL}][^{MATCHED}]*)*"
    if lasts > firsts:
        until += f"(?:{MATCHED}{CELL}{{{firsts + 1},{lasts}}}[^{CELL}][^\n]*)?"
    return F.transform(each, lambda row: let(F.regexp_extract(row, until, 0), lambda own: F.struct(*[of_row(own, c).alias(c) for c in places])))


def counts(block: Column, rule: LineRule) -> tuple[Column, Column]:
    """Numbers of the block's lines that aren't blank: of those that aren't skipped, and of those that are."""
    if rule.line_separator == "\n" and rule.skip_line and all(line_form(p) is not None for p in rule.skip_line):
        count = lambda skipped: F.regexp_count(block, F.lit(rf"(?dUm)^(?!\r*$){skipped}.+$"))
        hit = "|".join(map(_within, rule.skip_line))
        return count(f"(?!{hit})"), count(f"(?={hit})")
    every = F.filter(_split(block, rule), _printed)
    return F.size(F.filter(every, lambda l: ~_hit(l, rule.skip_line))), F.size(F.filter(every, lambda l: _hit(l, rule.skip_line)))


def rows(block: Column, rule: LineRule) -> Column:
    """Rows of one block as array<struct> of strings; a cell whose pattern the row never met is null.

    Without first and last lines, each line that fits is a row. Otherwise a fold over the lines: a
    first line opens a row, further lines add to an open one, a last line closes it.
    """
    if in_one(rule):
        return _rows_in_one(block, rule)
    columns = names(rule)
    shape = "struct<" + ",".join(f"`{c}`:string" for c in columns) + ">"
    lines = _lines(block, rule)
    if not rule.first_line and not rule.last_line:
        if simple(rule):
            own = {c: k for k, (c, _) in enumerate(translate(rule.line[0]).names)}
            return F.transform(cells(block, rule), lambda row: F.struct(*[_stripped(row[own[c]], c, rule).alias(c) for c in columns]).cast(shape))
        return F.transform(F.filter(lines, lambda l: _hit(l, rule.line)), lambda l: _row(l, rule.line, columns, None).cast(shape))
    if not rule.first_line:
        return F.array().cast(f"array<{shape}>")
    nothing = F.lit(None).cast(shape)
    state = F.struct(F.array().cast(f"array<{shape}>").alias("done"), nothing.alias("row"), F.lit(False).alias("open"))

    def closed(done: Column, row: Column) -> Column:
        return F.when(row.isNotNull(), F.concat(done, F.array(row))).otherwise(done)

    def step(a: Column, line: Column) -> Column:
        def made(done: Column, row: Column, is_open: bool) -> Column:
            return F.struct(done.alias("done"), row.cast(shape).alias("row"), F.lit(is_open).alias("open"))

        more = made(a["done"], _row(line, rule.line, columns, a["row"]), True)
        out = F.when(_hit(line, rule.first_line), made(closed(a["done"], a["row"]), _row(line, rule.first_line, columns, None), True))
        if rule.last_line:
            out = out.when(a["open"] & _hit(line, rule.last_line), made(F.concat(a["done"], F.array(_row(line, rule.last_line, columns, a["row"]).cast(shape))), nothing, False))
        return out.when(a["open"] & _hit(line, rule.line), more).otherwise(a)

    return F.aggregate(lines, state, step, lambda a: closed(a["done"], a["row"]))


def _coerced(kind: str | None, options: Options):
    return lambda cell: coerce(cell, kind, options)


def _replaced(pairs: Sequence[tuple[str, str]], kind: str | None, options: Options):
    return lambda cell: let(replace_all(cell, pairs), _coerced(kind, options)) if pairs else coerce(cell, kind, options)


def _rows_of(rule: LineRule):
    return lambda block: cells(block, rule) if simple(rule) else rows(block, rule)


def _rows_of_all(text: Column, rule: LineRule) -> Column:
    """Rows of all blocks of a text. Blocks that go by passes go by them as one, with a line between that ends an open row."""
    found = blocks(text, rule)
    if not in_one(rule):
        return F.flatten(F.transform(found, _rows_of(rule)))
    return _rows_of(rule)(F.array_join(found, f"\n{MATCHED}\n" if rule.first_line else "\n"))


def _typed(found: Column, rule: LineRule, columns: Sequence[str], options: Options, every: Sequence[str], kinds: dict[str, str], also: Derived) -> Column:
    types, replace = dict(rule.types), dict(rule.replace)
    own = {c: k for k, (c, _) in enumerate(translate(rule.line[0]).names)} if simple(rule) else None
    sources = list(dict.fromkeys(source for source, _ in also.values() if source in columns))

    def one(row: Column) -> Column:
        """What further columns are made of is bound, so that it is made once."""
        if not sources:
            return of(row, {})
        return let(F.struct(*[value(row, c).alias(c) for c in sources]), lambda bound: of(row, {c: bound[c] for c in sources}))

    def value(row: Column, c: str) -> Column:
        cell = row[c] if own is None else _stripped(row[own[c]], c, rule)
        if c not in replace and types.get(c) is None:
            return cell
        if own is not None and not _bare(c, rule):
            return let(cell, _replaced(replace.get(c, ()), types.get(c), options))
        return let(replace_all(cell, replace[c]), _coerced(types.get(c), options)) if c in replace else coerce(cell, types.get(c), options)

    def of(row: Column, held: dict[str, Column]) -> Column:
        cells = []
        for c in every:
            if c not in columns:
                cells.append(F.lit(None).cast(kinds[c]).alias(c))
                continue
            made = held[c] if c in held else value(row, c)
            cells.append(made.cast(kinds[c]).alias(c))
        for name, (source, make) in also.items():
            cells.append(make(held[source] if source in held else F.lit(None).cast("string")).alias(name))
        return F.struct(*cells)

    return F.transform(found, one)


def line_items(text: Column, field: LinesField, options: Options, also: Derived | None = None) -> Column:
    """All rows of all rules in order, as one array<struct>; a column's type is its rules' if they agree, else string.

    ``also`` are columns made of a row's others while it is at hand: making rows anew costs as much as the first time.
    """
    every = list(dict.fromkeys(c for r in field.rules for c in names(r)))
    spark = {"int": "bigint", "float": "double", "date": "timestamp_ntz", "datetime": "timestamp_ntz", None: "string"}
    kinds = {}
    for c in every:
        given = {dict(r.types).get(c) for r in field.rules if c in names(r)}
        kinds[c] = spark[given.pop()] if len(given) == 1 else "string"
    parts = []
    for r in field.rules:
        found = _rows_of_all(text, r)
        parts.append(_typed(found, r, names(r), options, every, kinds, also or {}))
    return F.concat(*parts)
