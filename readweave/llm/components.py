"""Connected components of a graph that is spread over the cluster, by alternating large-star and small-star steps.

Each step is a map-side combined minimum and a join on the node, which Spark splits if a node has many edges. An edge list
shrinks towards stars in a number of rounds that grows with the logarithm of the longest path. Each round is written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.session import cut_lineage, discard


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).withColumn("m", F.least("u", "m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    near = large.join(_lowest(large), "u")
    return near.select("u", F.col("m").alias("v")).union(near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``, in any order, repeats and loops allowed) that isn't the
    smallest of its component; ``root`` is that smallest node. No links: no rows."""
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        old, before = edges, mark
        edges = cut_lineage(_round(old))
        discard(old)
        mark = _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
