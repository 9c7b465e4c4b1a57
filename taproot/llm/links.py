"""Connected components of a table of links, by alternating large and small stars.

Each round is two aggregations and two joins over the links; the number of
rounds grows with the logarithm of the longest chain.  Links never leave the
executors; the driver sees one number a round.  (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from taproot.llm.shared import saved


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` that isn't its component's smallest."""
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        # At a fixed point every node points at its root, and the sums stay the same.
        seen = Observation()
        edges = saved(_small(_large(edges)).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "stars")
        now = seen.get
        if now == before or not now["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
