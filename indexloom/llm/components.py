"""Connected components of a table of links, by alternating star operations.

Large-star links every larger neighbour of a node to the node's smallest neighbour,
small-star every smaller one; both keep the components, and repeated they turn each
component into a star around its smallest node.  A round is two aggregations with map-side
combining and two joins.  No component is gathered in a list; the links of a node with very many
meet its smallest neighbour in a sort-merge join, which streams them and which adaptive execution splits by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.llm.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v.  One star operation; returns u > v."""
    if large:  # neighbours of both directions; larger ones go to the smallest
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours and the node itself go to the smallest
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: a, b.  Returns node, root (the smallest node of its component) of every linked node but roots."""
    edges = scratch.cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        new = scratch.cut(_star(_star(edges, True), False), "edges")
        scratch.drop(edges)
        edges = new
