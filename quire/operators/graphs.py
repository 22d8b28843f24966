"""Degrees, neighbourhoods, paths and viewports over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import written

MAX_HOPS = 6
LEAST_NODES, MOST_NODES = 50, 2_000


def symmetric(edges: DataFrame) -> DataFrame:
    """``a``, ``b``, ``label`` in both directions; labels of several edges are joined by name."""
    both = edges.select("a", "b", "label").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "label")).where("a <> b")
    return both.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("label"))


def degrees(triples: DataFrame) -> DataFrame:
    """One for each triple's subject and for each resource that is an object."""
    ends = triples.select(F.col("s").alias("node")).unionAll(triples.where("o_kind = 'uri'").select(F.col("o").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    return symmetric(edges).where(F.col("a") == node).select(F.col("b").alias("node"), "label")


def within(edges: DataFrame, starts: DataFrame, radius: int) -> DataFrame:
    """``node`` and ``hops`` of all nodes at most ``radius`` steps from any of ``starts`` (``node``). Each round joins the
    newest nodes only."""
    steps = written(symmetric(edges).select("a", "b"), "steps")
    known = new = written(starts.select("node").distinct().withColumn("hops", F.lit(0)), "reached")
    for hop in range(1, radius + 1):
        next_nodes = new.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        new = written(next_nodes.join(known, "node", "left_anti").withColumn("hops", F.lit(hop)), "reached")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def shortest_path(edges: DataFrame, start: str, end: str, *, max_hops: int = MAX_HOPS) -> DataFrame:
    """``hop``, ``node`` of a shortest path, empty if there is none of ``max_hops``; each node's parent is the smallest one.

    The path to itself is one node, if it has an edge.
    """
    spark = edges.sparkSession
    steps = written(symmetric(edges).select("a", "b"), "steps")
    present = steps.where(F.col("a") == start).limit(1).select(F.col("a").alias("node"))
    if present.isEmpty():
        return spark.createDataFrame([], "hop int, node string")
    level = written(present.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("hop")), "path")
    known, found = level, start == end
    for hop in range(1, max_hops + 1):
        if found:
            break
        reached = level.join(steps, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        level = written(reached.join(known.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "path")
        known = known.unionByName(level)
        if level.isEmpty():
            break
        found = not level.where(F.col("node") == end).isEmpty()
    if not found:
        return spark.createDataFrame([], "hop int, node string")
    path, node = [], end
    while node is not None:  # at most max_hops lookups of one row each
        row = known.where(F.col("node") == node).select("hop", "node", "parent").first()
        path.append((row["hop"], row["node"]))
        node = row["parent"]
    return spark.createDataFrame(path[::-1], "hop int, node string")


def viewport(nodes: DataFrame, edges: DataFrame, *, search: str | None = None, types: list[str] | None = None, budget: int = 500) -> DataFrame:
    """Nodes to show: those that match the search or type and their neighbours, the must-show ones first and then the best
    connected, within the budget (50 to 2,000). ``nodes``: ``id, type, degree, must, haystack``."""
    budget = max(LEAST_NODES, min(MOST_NODES, budget))
    chosen = nodes.where(F.col("type").isin(types)) if types else nodes
    if search:
        hits = chosen.where(F.contains("haystack", F.lit(search.lower()))).select(F.col("id").alias("node"))
        chosen = chosen.join(within(edges, hits, 1).select(F.col("node").alias("id")), "id", "left_semi")
    return chosen.orderBy(F.desc("must"), F.desc("degree"), "id").limit(budget)


def edges_between(edges: DataFrame, shown: DataFrame, limit: int = 1000) -> DataFrame:
    """Edges with both ends shown, by their ends."""
    ids = shown.select(F.col("id").alias("a"))
    return edges.join(ids, "a", "left_semi").join(ids.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b", "label").orderBy("a", "b", "label").limit(limit)
