"""Positioned words: cut out of an area and joined to lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose tops differ by no more than this from the word before are on its line, in points.
TOLERANCE = 3.0


def area_in_points(area: Mapping[str, float]) -> tuple[float, float, float, float]:
    """Left, top, right and bottom of an area given in pixels at ``r`` per inch."""
    scale = 72.0 / area["r"]
    return area["x"] * scale, area["y"] * scale, (area["x"] + area["W"]) * scale, (area["y"] + area["H"]) * scale


def inside(boxes: Column, area: Mapping[str, float]) -> Column:
    """The words of the area's pages that overlap it."""
    left, top, right, bottom = area_in_points(area)
    return F.filter(boxes, lambda b: b["page"].between(int(area["f"]), int(area["l"])) & (b["x1"] > left) & (b["x0"] < right) & (b["y1"] > top) & (b["y0"] < bottom))


def lines(boxes: Column) -> Column:
    """Text of the words: lines by page and top, words of a line from left to right."""
    key = lambda b: F.struct(b["page"].alias("page"), b["y0"].alias("y0"), b["x0"].alias("x0"), b["text"].alias("text"))
    ordered = F.array_sort(F.transform(boxes, key))
    word = "struct<x0:double,text:string>"
    state = F.struct(F.array().cast(f"array<array<{word}>>").alias("done"), F.array().cast(f"array<{word}>").alias("line"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("y"))

    def step(a: Column, b: Column) -> Column:
        one = F.array(F.struct(b["x0"].cast("double").alias("x0"), b["text"].alias("text"))).cast(f"array<{word}>")
        same = (a["page"] == b["page"]) & (F.abs(a["y"] - b["y0"]) <= TOLERANCE)
        full = F.when(F.size(a["line"]) > 0, F.concat(a["done"], F.array(a["line"]))).otherwise(a["done"])
        here = [b["page"].cast("int").alias("page"), b["y0"].cast("double").alias("y")]
        joined = F.struct(a["done"].alias("done"), F.concat(a["line"], one).alias("line"), *here)
        return F.when(F.coalesce(same, F.lit(False)), joined).otherwise(F.struct(full.alias("done"), one.alias("line"), *here))

    every = F.aggregate(ordered, state, step, lambda a: F.when(F.size(a["line"]) > 0, F.concat(a["done"], F.array(a["line"]))).otherwise(a["done"]))
    return F.array_join(F.transform(every, lambda l: F.array_join(F.transform(F.array_sort(l), lambda w: w["text"]), " ")), "\n")


def crop(boxes: Column, area: Mapping[str, float]) -> Column:
    return lines(inside(boxes, area))
