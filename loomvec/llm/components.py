"""Connected components of an edge table, by alternating star contractions.

Both steps only re-attach edges to smaller neighbours, so the edge table never grows
beyond its first size; it is written to the shared folder after each step. A hub of many
edges is aggregated before the shuffle; least neighbours are written first, so that the
join with them has plain tables on both sides and Spark splits a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.llm.common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Attach each larger neighbour of a node to the node's least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), name)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Attach a node and its smaller neighbours to the least of them (edges have a > b)."""
    least = scratch.write(edges.groupBy("a").agg(F.min("b").alias("least")), name)
    lower = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return lower.unionByName(least.select("a", F.col("least").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of an edge table (a, b); root is the component's least node.

    Self loops and repeated edges are allowed; a node without an edge to another is absent.
    The result reads the table ``name`` of ``scratch``.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = scratch.write(edges, name)
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while mark[0]:
        edges = scratch.write(_large_star(edges, scratch, f"{name}-least"), name)
        edges = scratch.write(_small_star(edges, scratch, f"{name}-least"), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    scratch.drop(f"{name}-least")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
