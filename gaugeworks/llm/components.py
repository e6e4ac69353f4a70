"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component_id) of every node of ``links`` (a, b); component_id is the least node.

    Each round every node takes its least smaller neighbour as parent, parents
    are followed to roots by doubling, and the links are drawn anew between
    roots.  A root stays a root only if all its neighbours are larger, so the
    roots at least halve: the rounds grow with the logarithm of the nodes.  All
    tables of a round are written to the shared folder; nothing is collected
    but counts.  Keys may be hot: groups are partial minima, and both sides of
    each join are scans, whose hot partitions adaptive execution splits.
    """
    edges = scratch.table(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
    )
    names = None
    while not edges.isEmpty():
        parent = scratch.table(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "parent")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            after = scratch.table(
                parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")),
                "parent",
            )
            moved = not after.where("moved").isEmpty()
            scratch.drop(parent)
            parent = after.drop("moved")
            parent._scratch_path = after._scratch_path
            if not moved:
                break
        a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        # every b has a parent; an a that has none is a root
        redrawn = edges.join(a, "a", "left").join(b, "b").select(F.coalesce("ra", "a").alias("x"), F.col("rb").alias("y")).where("x <> y")
        after = scratch.table(redrawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        scratch.drop(edges)
        edges = after
        if names is None:
            names = parent
        else:
            later = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            merged = names.join(later, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            after = scratch.table(merged.unionByName(parent), "names")
            scratch.drop(names, parent)
            names = after
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component_id"))
    known = names.select("node", F.col("root").alias("component_id"))
    roots = known.select(F.col("component_id").alias("node")).distinct().withColumn("component_id", F.col("node"))
    return known.unionByName(roots)
