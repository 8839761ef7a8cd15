"""How much of what is known to be right an extraction has found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.binding import let

#: What no number begins with: casting such a text fails, and each failure costs as much as a record's other comparisons.
_NO_NUMBER = r"^(?:\d+[-/]\d|[A-HJ-MO-Za-hj-mo-z])"


def _plain(value: Column) -> Column:
    """Numbers and times in one form each."""
    bare = F.when(value.contains("00:00:00"), F.regexp_replace(value, r"[ T]00:00:00(?:\\.0+)?$", "")).otherwise(value)
    return let(bare, lambda text: F.when(text.rlike(_NO_NUMBER), text).otherwise(F.coalesce(text.try_cast("double").cast("string"), text)))


def score(found: DataFrame, golden: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``matched`` and ``total`` fields of every golden record, and ``lacking``, the names of the others.

    Both frames have the id and ``record`` (VARIANT). Of a list only its length must agree; a document
    that isn't among those found, or has no record, matches nothing.
    """
    # Values stay variants until a wanted name asks for one: most of a record is in lists that nobody compares.
    held = lambda f, name: f.select(id_column, F.try_variant_get("record", "$", "map<string,variant>").alias(name))
    both = held(golden, "want").join(held(found, "got"), id_column, "left")
    names = F.map_keys("want")

    def agrees(name: Column) -> Column:
        text = lambda of: F.try_variant_get(F.try_element_at(of, name), "$", "string")
        return let(F.struct(text("want").alias("want"), text("got").alias("got")), lambda v: equal(v["want"], v["got"]))

    def equal(want: Column, got: Column) -> Column:
        size = F.json_array_length(want)
        return F.coalesce(F.when(want.startswith("[") & size.isNotNull(), F.json_array_length(got) == size).otherwise(_plain(want) == _plain(got)), F.lit(False))

    lacking = F.filter(names, lambda n: ~agrees(n))
    return both.select(id_column, (F.size(names) - F.size(lacking)).cast("bigint").alias("matched"), F.size(names).cast("bigint").alias("total"), F.array_sort(lacking).alias("lacking"))
