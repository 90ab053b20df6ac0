"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import discarded, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node of its component.

    Each step is two aggregations and joins over the edges, which never grow in
    number beyond the nodes plus the edges; a hub's many edges meet only one
    row of the other side, so Spark can split them.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = written(e, "cc")
    while not _stars(e):  # the number of rounds grows with the logarithm of the longest path
        sym = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = written(large, "cc-large")
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before, e = e, written(small.union(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "cc")
        discarded(before, large)
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)


def _stars(e: DataFrame) -> bool:
    """Whether every ``hi`` has one ``lo``, which is nobody's ``hi``: then each component is its least node with all others around it."""
    ends = e.select(F.col("hi").alias("node"), F.lit(1).alias("up")).union(e.select(F.col("lo").alias("node"), F.lit(0).alias("up")).distinct())
    bad = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 or (up > 0 and low = 0)")
    return bad.isEmpty()
