"""Provenance graphs: cones, worst inputs and referential checks."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.ranges import checkpointed


def cone(edges: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """(root, node, depth): everything reachable along (src, dst) edges and the least number of steps.

    A breadth-first frontier: each round joins the newest nodes only, and nodes
    already reached are not visited again, so cycles end.  Rounds go on until
    nothing is new; with a ``limit``, cones deeper than that raise an error.
    """
    reached = start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct()
    frontier = reached
    for depth in itertools.count(1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        fresh = checkpointed(step.join(reached, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        if limit is not None and depth > limit:
            raise ValueError(f"cones are deeper than {limit} steps")
        reached, frontier = reached.unionByName(fresh), fresh
        if depth % 8 == 0:
            reached = checkpointed(reached)
    return reached


def worst_input(cones: DataFrame, health: DataFrame) -> DataFrame:
    """For each root the greatest health rank of anything in its cone; nodes without one are left out."""
    return cones.join(health, "node").groupBy("root").agg(F.max("rank").alias("worst"), F.count("*").alias("inputs"))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, node): edge ends that are no node, and nodes without any edge."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    dangling = ends.join(nodes.select("node"), "node", "left_anti").select(F.lit("dangling").alias("rule"), "node")
    orphan = nodes.select("node").distinct().join(ends, "node", "left_anti").select(F.lit("orphan").alias("rule"), "node")
    return dangling.unionByName(orphan)


def lineage_problems(
    artifacts: DataFrame, files: DataFrame, transforms: DataFrame, scripts: DataFrame, writes: DataFrame, reads: DataFrame, sources: DataFrame, used: DataFrame, dictionaries: DataFrame
) -> DataFrame:
    """(rule, node, detail) of every break in a lineage that is written down against what there is.

    artifacts (id, file, producer, retired), files (file), transforms (id,
    script), scripts (script, text), writes and reads (transform, id), sources
    (id, name, dictionary), used (source, column), dictionaries (dictionary,
    column).  Rules: a file that is no artifact; an artifact without its file, or
    without a producer unless retired; a transform without its script; a write
    to no artifact, a read of neither artifact nor source; a write whose file, or
    a read whose source, the script does not name; a used column that its
    dictionary lacks (letter case aside), a source whose dictionary is missing.
    Each rule is a join by key that keeps what found no partner.
    """

    def broken(rule: str, rows: DataFrame, node: str, detail: str) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), F.col(node).cast("string").alias("node"), F.col(detail).cast("string").alias("detail"))

    ends = artifacts.select("id").unionByName(sources.select("id")).distinct()
    texts = transforms.join(scripts, "script").select(F.col("id").alias("transform"), "text")
    written = writes.join(artifacts.select("id", "file"), "id").join(texts, "transform")
    read = reads.join(sources.select("id", "name"), "id").join(texts, "transform")
    listed = dictionaries.select("dictionary", F.lower("column").alias("_c")).distinct()
    columns = used.join(sources.select(F.col("id").alias("source"), "dictionary"), "source").withColumn("_c", F.lower("column"))
    known = columns.join(listed.select("dictionary").distinct(), "dictionary", "left_semi")
    found = [
        broken("orphan file", files.join(artifacts, "file", "left_anti"), "file", "file"),
        broken("missing file", artifacts.join(files, "file", "left_anti"), "id", "file"),
        broken("no producer", artifacts.where("producer is null and not coalesce(retired, false)"), "id", "file"),
        broken("missing script", transforms.join(scripts, "script", "left_anti"), "id", "script"),
        broken("unknown write", writes.join(artifacts, "id", "left_anti"), "transform", "id"),
        broken("unknown read", reads.join(ends, "id", "left_anti"), "transform", "id"),
        broken("write not in script", written.where("not contains(text, file)"), "transform", "file"),
        broken("read not in script", read.where("not contains(text, name)"), "transform", "name"),
        broken("column not in dictionary", known.join(listed, ["dictionary", "_c"], "left_anti"), "source", "column"),
        broken("missing dictionary", sources.where("dictionary is not null").join(listed.select("dictionary").distinct(), "dictionary", "left_anti"), "id", "dictionary"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
