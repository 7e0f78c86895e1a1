"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage


def _linked(edges: DataFrame) -> DataFrame:
    """Each node with each neighbour and the smallest among itself and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least.select("a", F.least("a", "m").alias("m")), "a")


def _settled(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of the component.

    Each round rewrites edges only, at most as many as before; hubs are split by the join's skew
    handling and their minima combined before shuffling. The number of rounds grows with the logarithm of the
    longest path.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _settled(edges)) != before:
        before = now
        # larger neighbours go to the smallest; then all smaller ones do
        edges = _linked(edges).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        rest = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = cut_lineage(rest.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
