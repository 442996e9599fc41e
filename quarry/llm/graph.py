"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _facts(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to its smallest neighbour (itself included)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v longs): its smallest node.

    Each round is two joins on node ids and cuts its lineage with a table in the shared
    folder; rounds grow with the logarithm of the longest path. A node that many edges
    share has one row on the other side of its join, so adaptive execution can split it.
    Loops and repeated edges are allowed; an empty table gives an empty one.
    """
    e = staged(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    before = _facts(e)
    while before[0]:
        e = staged(_small_star(_large_star(e)), "edges")
        after = _facts(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
