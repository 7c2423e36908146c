"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depotlane.llm.tables import cut


def _least(pairs: DataFrame) -> DataFrame:
    """For each u the least of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


#: Edges in one part of a table between rounds: small rounds then write few files.
EDGES_IN_PART = 100_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of an edge (u, v) reaches.

    Each round is a few aggregations and joins; a node of many edges is pre-aggregated, and
    the join back to its edges is one that Spark can split. Rounds end when none changes an
    edge; edges shrink to stars in a number of rounds that grows as the logarithm of the size.
    """
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = sign(edges)
    parts = 1 + now[0] // EDGES_IN_PART
    edges = edges.coalesce(parts)
    while True:
        edges = cut(_small_star(_large_star(edges, parts), parts))
        before, now = now, sign(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select("v", "v").distinct().toDF("node", "root"))
