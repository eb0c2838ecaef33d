"""Connected components of an edge table by alternating stars.

Every round hangs larger neighbours below the smallest one, first those above
a node, then those below it; the edges shrink to stars in a logarithmic number of
rounds.  Each round is written out; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.plans.durable import materialise


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges (a, b)`` (longs): the smallest node it is joined to."""
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = _least(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = materialise(small, "stars")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
        seen = state
