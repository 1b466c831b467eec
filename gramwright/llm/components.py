"""Connected components by large-star and small-star steps, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v) in both directions -> (v, least neighbour of u) for v > u, and (u, that)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b), longs -> (node, component): component is the least node
    that can be reached. Nodes without an edge to another are not returned.

    Every step leaves its edges in the shared folder, so that a lost executor
    costs one step. Edges are never collected. Steps go on until one changes
    nothing, which each brings nearer: a chain is about halved by a step.
    """
    rows = edges.count()  # no step makes more links than there were
    links = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", rows=rows)
    mark, settled = None, False
    while not settled:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node's smaller neighbours, itself among them, meet at the least
        small = _stars(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, links = links, materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links", rows=rows)
        discard(before)
        now = tuple(links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first())
        settled, mark = now == mark, now
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
