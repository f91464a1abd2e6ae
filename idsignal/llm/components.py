"""Connected components of an undirected graph as Spark joins.

Each round every node points to its smallest neighbour (or itself), pointers are followed by
doubling until they stand still, and the graph is contracted to the roots. A node with a neighbour
is either no root or has one pointing to it, so the node count at least halves per round.
Every table is written to the shared folder: lineage stays short, a lost executor costs one step,
and both sides of each join are plain scans, whose hot keys Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from idsignal.workspace import stage


def roots(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of `edges` (u, v); root is the smallest node reached."""
    edges = stage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                  .where("u < v").distinct(), f"{name}-edges")
    found = None
    while edges.limit(1).count():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pointers = stage(both.groupBy(F.col("u").alias("node"))
                         .agg(F.least(F.min("v"), F.first("u")).alias("root")), f"{name}-pointers")
        while True:
            above = pointers.select(F.col("node").alias("root"), F.col("root").alias("top"))
            moved = stage(pointers.join(above, "root").select("node", F.col("top").alias("root"),
                          (F.col("top") != F.col("root")).alias("moved")), f"{name}-pointers")
            pointers = moved.select("node", "root")
            if not moved.where("moved").limit(1).count():
                break
        if found is None:
            found = pointers
        else:
            up = pointers.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = stage(found.join(up, "root", "left")
                          .select("node", F.coalesce("top", "root").alias("root")), f"{name}-found")
        left = pointers.select(F.col("node").alias("u"), F.col("root").alias("a"))
        right = pointers.select(F.col("node").alias("v"), F.col("root").alias("b"))
        half = stage(edges.join(left, "u").select("a", "v"), f"{name}-half")
        edges = stage(half.join(right, "v").where("a != b")
                      .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{name}-edges")
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found
