"""Connected components of an edge table, by alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import Workspace


def _least(edges: DataFrame) -> DataFrame:
    """Edges with ``m``, the least ``v`` of their ``u``: added up before the shuffle and joined back, so a node with very many edges is gathered nowhere."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    hooks = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooks.unionAll(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``u``, ``v`` for every node but the least of its component, ``v`` being that least node.

    ``edges`` has integer columns ``u`` and ``v`` in either order; loops, repeats and null ends have
    no effect. Each round writes its edges, so lost executors cost one round at most, and the rounds
    grow with the logarithm of the nodes.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, k = work.table(ordered, "edges0"), 0
    mark = _mark(now)
    while True:
        k += 1
        after = work.table(_small_star(_large_star(now).where("u <> v").distinct()).where("u <> v").distinct(), f"edges{k}")
        fresh = _mark(after)
        work.drop(f"edges{k - 1}")
        if fresh == mark:
            return after
        now, mark = after, fresh
