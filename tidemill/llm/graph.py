"""Connected components of an edge list, for the operators that group documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(neighbours: DataFrame, keep) -> DataFrame:
    """Every neighbour b of a that `keep` allows is tied to the least of a and its neighbours."""
    least = neighbours.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return neighbours.join(least, "a").filter(keep).select(F.col("b").alias("a"), F.col("low").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node of its component, which has no row of its own.

    Alternating large and small stars (Kiveris et al., 2014) until nothing changes; each round is stored in the checkpoint folder.
    """
    now, seen = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        large = _star(_both_ways(now), F.col("b") > F.col("a"))
        large = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = cut_lineage(small.unionByName(lows.select("a", F.col("low").alias("b"))).distinct())
