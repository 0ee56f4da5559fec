"""Connected components of a link table, as rounds of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star step on (u, v) with v < u. Large: every neighbour above u points
    to the least of u's neighbourhood; small: u and its lower neighbours do."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = settle(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    met = near.join(least, "u")
    moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if both else met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return settle(moved.where("u <> v").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node that
    can be reached. Self-links give components of one node.

    Alternates large and small stars (Kiveris et al. 2014) until a round leaves
    the edges as they were; each round is written, so a lost executor costs at
    most one. A node's neighbours are reduced to their minimum before the
    shuffle, and the join back is one that splits hot nodes.
    """
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    seen = mark(edges)
    while seen["n"]:
        edges = _star(_star(edges, True), False)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
