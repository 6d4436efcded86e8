"""Connected components of an edge table by repeated contraction to smaller neighbours; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _jump(parent: DataFrame) -> DataFrame:
    """Each node's root, by doubling; `parent` has one row (node, root) with root < node."""
    parent, _ = save(parent.withColumn("moved", F.lit(True)), "parent")
    while not parent.where("moved").isEmpty():
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        parent, _ = save(parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "parent")
    return parent.select("node", "root")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a long, b long): root is the smallest node of its component.

    Loops, repeated and reversed edges change nothing. Each round links every node to its smallest neighbour and merges
    what hangs together, so few rounds suffice; every round's tables are written to the shared folder.
    """
    edges, _ = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    left = edges.where("a < b")
    while not left.isEmpty():
        roots = _jump(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        of_a, of_b = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
        left, _ = save(
            left.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")).where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges",
        )
        nodes = nodes.join(roots.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return nodes
