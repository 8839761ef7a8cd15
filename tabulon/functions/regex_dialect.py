"""Template patterns (Python syntax) as patterns of the JVM's engine, where both mean the same."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import lru_cache


class NotPortable(ValueError):
    """The pattern needs the Python engine."""


@dataclass(frozen=True)
class Pattern:
    """A translated pattern: ``java`` text, number of groups, and group numbers by name."""

    source: str
    java: str
    groups: int
    names: tuple[tuple[str, int], ...]

    @property
    def anchored(self) -> bool:
        """It looks at what lies before a match, so slicing a text changes what it finds."""
        return bool(re.search(r"\^|\(\?<[=!]|\\[AbB]", self.source))


#: Flags that give Java's engine Python's ideas of line ends, digits, word signs and blanks.
FLAGS = "(?dU)"


def _char_class(source: str, at: int) -> tuple[str, int]:
    """Translation of the class that opens at ``at``, and the place after it."""
    out, i = "[", at + 1
    if source[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first = True
    while True:
        c = source[i : i + 1]
        if not c:
            raise NotPortable("unclosed class")
        if c == "]" and not first:
            return out + "]", i + 1
        if c == "\\":
            if source[i + 1] in "0123456789NZ":
                raise NotPortable("number escape in a class")
            out, i = out + source[i : i + 2], i + 2
        elif c in "[]&~|" or (c == "^" and first):
            out, i = out + "\\" + c, i + 1
        else:
            out, i = out + c, i + 1
        first = False


@lru_cache(maxsize=4096)
def translate(source: str) -> Pattern:
    """The pattern for Java's engine; NotPortable where the meaning could differ."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)  # signs that later versions may read otherwise are escaped here
            compiled = re.compile(source)
    except re.error as error:
        raise NotPortable(str(error)) from error
    out, i, opened = [], 0, 0
    if re.match(r"\(\?[a-z]+\)", source):
        lead = re.match(r"\(\?([a-z]+)\)", source)
        if set(lead[1]) - set("imsx"):
            raise NotPortable("flag")
        out.append(lead[0])
        i = lead.end()
        if "x" in lead[1]:
            raise NotPortable("verbose")
    while i < len(source):
        c = source[i]
        if c == "\\":
            n = source[i + 1]
            if n == "Z":
                out.append(r"\z")
            elif n in "0N" or (n.isdigit() and n != "0"):
                raise NotPortable("back reference or number escape")
            else:
                out.append(source[i : i + 2])
            i += 2
        elif c == "[":
            text, i = _char_class(source, i)
            out.append(text)
        elif source.startswith("(?P<", i):
            i = source.index(">", i) + 1
            out.append("(")
            opened += 1
        elif source.startswith(("(?P=", "(?(", "(?#"), i):
            raise NotPortable("named back reference, condition or comment")
        elif source.startswith("(?", i):
            scoped = re.match(r"\(\?(?:[ims]*(?:-[ims]+)?:|[=!>]|<[=!])", source[i:])
            if not scoped:
                raise NotPortable("extension")
            out.append(scoped[0])
            i += scoped.end()
        elif c == "{" and (low := re.match(r"\{,(\d+)\}", source[i:])):
            out.append(f"{{0,{low[1]}}}")
            i += low.end()
        elif c == "{" and not re.match(r"\{\d+(,\d*)?\}", source[i:]):
            out.append(r"\{")
            i += 1
        elif c == "}" and not re.search(r"\{\d*,?\d*$", source[:i]):
            out.append(r"\}")
            i += 1
        else:
            opened += c == "("
            out.append(c)
            i += 1
    if opened != compiled.groups:
        raise NotPortable("groups")
    return Pattern(source, FLAGS + "".join(out), compiled.groups, tuple(sorted(compiled.groupindex.items(), key=lambda x: x[1])))


def _no_space(items) -> bool:
    """Nothing of a parsed pattern takes white space."""
    for op, value in items:
        kind = str(op)
        if kind == "LITERAL":
            if chr(value).isspace():
                return False
        elif kind == "IN":
            for part, what in value:
                if str(part) == "LITERAL" and not chr(what).isspace() or str(part) == "RANGE" and what[0] > 32 and what[1] < 127 or str(part) == "CATEGORY" and str(what) in ("CATEGORY_DIGIT", "CATEGORY_WORD"):
                    continue
                return False
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            if not _no_space(value[2]):
                return False
        elif kind == "SUBPATTERN":
            if not _no_space(value[3]):
                return False
        elif kind == "BRANCH":
            if not all(map(_no_space, value[1])):
                return False
        elif kind != "AT":
            return False
    return True


@lru_cache(maxsize=4096)
def spaceless(source: str) -> frozenset[str]:
    """Named groups of a pattern that never hold white space, so that they needn't be stripped."""
    parsed = re._parser.parse(source)
    names = {n: k for k, n in parsed.state.groupdict.items()}
    out: set[str] = set()

    def walk(items) -> None:
        for op, value in items:
            kind = str(op)
            if kind == "SUBPATTERN":
                if value[0] in names and _no_space(value[3]):
                    out.add(names[value[0]])
                walk(value[3])
            elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                walk(value[2])
            elif kind == "BRANCH":
                for branch in value[1]:
                    walk(branch)

    walk(parsed)
    return frozenset(out)


#: Noncharacters that stand between cells while a match is taken apart; texts must not hold them.
CELL, MATCHED = "\ufdd0", "\ufdd1"


def whole_line(pattern: Pattern) -> str:
    """A pattern that takes a whole text in which the first match of ``pattern`` lies; groups keep their numbers."""
    return f"{FLAGS}^(?s:.)*?(?:{pattern.java.removeprefix(FLAGS)})(?s:.)*$"


@lru_cache(maxsize=4096)
def line_form(source: str) -> str | None:
    """The pattern, without flags, for use within a text of many lines: nothing in it takes a line's end.

    Null where it can't be said so: lines looked at one by one are then the only way. Anchors need
    the flag (?m) of the pattern that it becomes a part of.
    """
    java = translate(source).java.removeprefix(FLAGS)
    if re.search(r"\n|\(\?(?!:)|[*+?}]\+", java):
        return None
    out, i = [], 0
    while i < len(java):
        c = java[i]
        if c == "\\":
            kind = java[i + 1]
            if kind in "sWD":
                out.append(rf"[\{kind}&&[^\n]]")
            elif kind in "Swdb" or not kind.isalnum():
                out.append(java[i : i + 2])
            else:
                return None
            i += 2
        elif c == "[":
            end = i + 1
            while java[end] != "]" or end == i + 1 or java[i + 1 : end] == "^":
                if java[end] == "\\":
                    if java[end + 1].isalnum() and java[end + 1] not in "sSwWdD":
                        return None
                    end += 1
                end += 1
            body = java[i : end + 1]
            if body.startswith("[^"):
                body = body[:-1] + r"\n]"
            elif re.search(r"\\[sWD]|[\0-\n]", body):
                body = rf"[{body}&&[^\n]]"
            out.append(body)
            i = end + 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def at_start(source: str) -> bool:
    """The pattern fits at a text's start only."""
    parsed = re._parser.parse(source)
    return bool(parsed) and str(parsed[0][0]) == "AT" and str(parsed[0][1]) == "AT_BEGINNING"


def literal(source: str) -> str | None:
    """What a pattern matches if that is one text only, none of whose ends is its beginning too; matches then can't overlap."""
    parsed = re._parser.parse(source)
    if not parsed or parsed.state.flags & ~re.UNICODE.value or any(str(op) != "LITERAL" for op, _ in parsed):
        return None
    text = "".join(chr(value) for _, value in parsed)
    return None if any(text.endswith(text[:k]) for k in range(1, len(text))) else text


def portable(source: str) -> bool:
    try:
        translate(source)
    except NotPortable:
        return False
    return True


def replacement(text: str) -> str:
    """A replacement in Python syntax as one of Java's."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            if m := re.match(r"\\g<(\d+)>", text[i:]):
                out.append(f"${m[1]}")
                i += m.end()
                continue
            if text[i + 1].isdigit():
                out.append("$" + text[i + 1])
            else:
                out.append({"n": "\n", "t": "\t", "r": "\r"}.get(text[i + 1], "\\" + text[i + 1]))
            i += 2
            continue
        out.append("\\" + c if c == "$" else c)
        i += 1
    return "".join(out)
