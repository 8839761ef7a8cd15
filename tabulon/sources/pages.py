"""Text of web pages, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def html_text(html: Column) -> Column:
    """What a page shows: without scripts, styles, comments and tags; blocks on lines of their own."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    broken = F.regexp_replace(bare, r"(?i)<(?:br|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|title))\b[^>]*>", "\n")
    text = F.regexp_replace(broken, r"<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", html_text(F.col("html")).alias("text"))
