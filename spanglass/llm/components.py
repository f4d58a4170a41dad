"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanglass.llm.shared import table_of


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: bigint); root is one node for each component.

    Each round maps every node to the smallest of itself and its neighbours, an aggregation
    that combines before the shuffle, so a node with very many links is no burden; the edges are
    then drawn between the images.  Node ids should be spread like hashes: a round then removes
    about half of the nodes or more.  Loops, repeated edges and an empty table are fine.
    """
    edges = table_of(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        image = table_of(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("image")), "image")
        moved = edges.join(image, edges.a == image.node).select(F.col("image").alias("a"), "b")
        moved = moved.join(image, moved.b == image.node).select("a", F.col("image").alias("b"))
        edges = table_of(moved.filter("a <> b").distinct(), "edges")
        if roots is None:
            roots = image.withColumnRenamed("image", "root")
        else:
            step = image.withColumnRenamed("node", "at")
            roots = table_of(roots.join(step, roots.root == step["at"], "left").select("node", F.coalesce("image", "root").alias("root")), "roots")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
