"""Connected components of an edge table, by alternating large and small stars.

Each round is a handful of grouped minima and equi-joins over the edges and is written to the
shared folder, from where the round before goes; the number of rounds grows with the logarithm of the longest path.  Nothing is
brought to the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges(a, b)`` but the roots; a root is its component's smallest node.

    Self loops and repeated edges do no harm; no edges give no rows.
    """
    edges = settle(edges.where("a <> b").select("a", "b").distinct())
    mark = _mark(edges)
    while mark[0]:
        before, edges = edges, settle(_small_star(_large_star(edges)))
        discard(edges.sparkSession, before)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
