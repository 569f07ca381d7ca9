"""Connected components of a graph given by its edges, with no vertex list or edge list on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteprism.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: each vertex links its larger (or not larger) neighbours to its least neighbour.

    The least neighbour comes from a map-side-combined minimum and the join back is by vertex, so that a
    vertex with a third of all edges is a skewed join that adaptive execution splits, not one long group.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("v"), F.least("a", "m").alias("m")) if large else least.select(F.col("a").alias("v"), "m")
    linked = both.join(least, F.col("a") == F.col("v"))
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = linked.where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return out.where(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Vertex and least vertex of its component, for every vertex that has an edge.

    ``edges`` has long columns a and b; direction, repeats, loops and nulls don't matter. Alternating
    large-star and small-star rounds (each linear in the edges) reach stars in O(log^2 n) rounds; each
    round is written to the shared folder, so the lineage stays short. Empty edges give an empty result.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    mark = None
    for _ in range(rounds):
        edges = materialise(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
