"""Connected components of an undirected graph, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tables


def _least_neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (columns a, b); a component's name is its smallest node.

    Alternating star contraction: each node hands its larger neighbours, then its
    smaller ones, to the smallest it knows. Rounds grow with the logarithm of the
    longest chain; each is written to the shared folder, and a node with very many
    links meets one row of its minimum, never a gathered list. Loops and repeated
    links are allowed; an empty graph has no rows.
    """
    edges = tables.store(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        # Large star: larger neighbours of u go to the least of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbours(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours of u, and u, go to the least of them.
        least = _least_neighbours(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tables.store(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
