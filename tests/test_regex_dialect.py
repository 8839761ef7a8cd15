import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.functions.regex_dialect import NotPortable, replacement, translate

PATTERNS = [r"(?P<a_b>\d+)-(?P<c>\w*)", r"a{,2}b", r"[[a&&b]+", r"x$", r"^a|b\Z", r"(?i)AB+", r"(?:a|b)(c)?", r"a{x}", r"[^]a]+", r"\s+\S", r"(?m)^a.c$", r".+", r"(?=a)a.", r"[a\-z]+|-"]
TEXTS = ["12-ab", "bbaab", "[a&b", "x\n", "x\r\n", "b", "abAB", "acb", "a{x}", "]]a^", " \t　x", "a\rc\nabc", "٣-é", "a-z", ""]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_both_engines_find_the_same(spark, pattern):
    p = translate(pattern)
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = frame.select("t", F.regexp_extract_all("t", F.lit(p.java), F.lit(0)).alias("found"), F.regexp_extract("t", p.java, p.groups).alias("group")).collect()
    for r in rows:
        assert list(r.found) == [m[0] for m in re.finditer(pattern, r.t)], r.t
        m = re.search(pattern, r.t)
        assert r.group == ((m[p.groups] or "") if m else "")


@pytest.mark.parametrize("pattern", [r"(a)\1", r"(?P<a>x)(?P=a)", r"(a)?(?(1)b|c)", r"(?x) a # b", r"\0", "(", r"(?a)\w"])
def test_what_needs_python(pattern):
    with pytest.raises(NotPortable):
        translate(pattern)


def test_replacements(spark):
    for pattern, by, text in ((r"(a)(b)", r"\2-\1", "xabx"), ("a", "$1", "a"), (r"(\d)", r"<\g<1>>", "1 2"), ("a", r"\\", "a"), ("a", r"\n", "a")):
        got = spark.range(1).select(F.regexp_replace(F.lit(text), translate(pattern).java, replacement(by))).first()[0]
        assert got == re.sub(pattern, by, text)


@given(st.lists(st.text(alphabet="ab1 \n\t.-é", max_size=12), min_size=1, max_size=5))
@settings(max_examples=15, deadline=None)
def test_random_texts(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (r"\b\w+\b", r"\d|\s$", r"a.b?", r"[^\s.]+"):
        for r in frame.select("t", F.regexp_extract_all("t", F.lit(translate(pattern).java), F.lit(0)).alias("found")).collect():
            assert list(r.found) == [m[0] for m in re.finditer(pattern, r.t)]
