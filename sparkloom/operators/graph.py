"""Bounded graph traversal over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.sources.work import Tables


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, distance: nodes within depth steps of the roots (node), each at its smallest distance.

    One join a level. Every level is written, so the next one reads its frontier instead of making it
    again; what was reached before drops out by an anti-join, so cycles end.
    """
    tables = Tables(edges.sparkSession, "reach")
    frontier = tables.written(roots.select("node", F.lit(0).alias("distance")).distinct())
    found = frontier
    steps = tables.written(edges.select("from_id", "to_id").distinct()) if depth > 1 else edges.select("from_id", "to_id").distinct()
    for d in range(1, depth + 1):
        new = frontier.join(steps, frontier.node == steps.from_id).select(F.col("to_id").alias("node")).distinct()
        frontier = tables.written(new.join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)))
        found = found.union(frontier)
    return found


def reachable(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """a, b, reached for each distinct pair: whether b is within depth steps of a (itself in none).

    Searches from all starts run together, a level at a time; a level has a row for each start and node it first sees.
    """
    tables = Tables(edges.sparkSession, "reachable")
    steps = tables.written(edges.select("from_id", "to_id").distinct())
    pairs = tables.written(pairs.select("a", "b").distinct())
    level = tables.written(pairs.select(F.col("a").alias("root"), F.col("a").alias("node")).distinct())
    found = level
    for _ in range(depth):
        new = level.join(steps, level.node == steps.from_id).select("root", F.col("to_id").alias("node")).distinct()
        level = tables.written(new.join(found, ["root", "node"], "left_anti"))
        found = found.union(level)
    hit = found.select(F.col("root").alias("a"), F.col("node").alias("b"), F.lit(True).alias("hit"))
    return pairs.join(hit, ["a", "b"], "left").select("a", "b", F.coalesce("hit", F.lit(False)).alias("reached"))


def subgraph(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """The edges that leave nodes nearer than depth to the roots, with the distance of their start; those to nodes seen before too."""
    near = reach(edges, roots, depth - 1) if depth > 1 else roots.select("node", F.lit(0).alias("distance"))
    return edges.join(near, edges.from_id == near.node).drop("node")


def impact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, affected, depends, risk: users of a node, what it depends on, and a grade of affected + depends / 2."""
    users = edges.groupBy(F.col("to_id").alias("node")).agg(F.count_distinct("from_id").alias("affected"))
    needs = edges.groupBy(F.col("from_id").alias("node")).agg(F.count_distinct("to_id").alias("depends"))
    both = nodes.join(users, "node", "left").join(needs, "node", "left").select("node", F.coalesce("affected", F.lit(0)).alias("affected"), F.coalesce("depends", F.lit(0)).alias("depends"))
    score = F.col("affected") + F.floor(F.col("depends") / 2)
    return both.withColumn("risk", F.when(score <= 2, "low").when(score <= 7, "medium").otherwise("high"))


def community_overlap(before: DataFrame, after: DataFrame) -> DataFrame:
    """a, b, both, jaccard of communities (id, community) of two snapshots that share a node; no pair is made without one."""
    size = lambda df, name: df.groupBy("community").agg(F.count_distinct("id").alias(name))
    pairs = before.select("id", F.col("community").alias("a")).distinct().join(after.select("id", F.col("community").alias("b")).distinct(), "id").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = pairs.join(size(before, "na").withColumnRenamed("community", "a"), "a").join(size(after, "nb").withColumnRenamed("community", "b"), "b")
    return out.select("a", "b", "both", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def shortest_paths(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, path: of the shortest paths from a root (node) within depth steps, the first in order.

    Each level keeps one path a node and is written, so its rows are at most the nodes and its plan is one join.
    """
    tables = Tables(edges.sparkSession, "paths")
    frontier = tables.written(roots.select("node", F.array("node").alias("path")).groupBy("node").agg(F.min("path").alias("path")))
    found = frontier
    steps = edges.select("from_id", "to_id").distinct()
    for _ in range(depth):
        new = frontier.join(steps, frontier.node == steps.from_id).select(F.col("to_id").alias("node"), F.concat("path", F.array("to_id")).alias("path"))
        frontier = tables.written(new.join(found.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        found = found.union(frontier)
    return found


def second_hop(edges: DataFrame) -> DataFrame:
    """node, transitive, deep: users of a node's users, and whether there are any.

    The count is of different nodes, so the pairs themselves are shuffled: in-degree times out-degree of
    each node between at most, after both sides are made distinct.
    """
    a = edges.select("from_id", "to_id").distinct()
    b = a.select(F.col("from_id").alias("mid"), F.col("to_id").alias("node"))
    pairs = a.join(b, a.to_id == b.mid).select("node", "from_id").distinct()
    return pairs.groupBy("node").agg(F.count("*").alias("transitive")).withColumn("deep", F.col("transitive") > 0)


def impact_of(edges: DataFrame, targets: DataFrame, most_inbound: int = 20, relation: str = "uses") -> DataFrame:
    """target, node, relation: who is affected by a change of each target (node): all its users, and the inbound edges of most weight.

    Each (node, relation) once; ties of weight go to the first node.
    """
    inbound = edges.join(targets.select(F.col("node").alias("to_id")), "to_id")
    users = inbound.where(F.col("relation") == relation)
    heavy = inbound.withColumn("_n", F.row_number().over(W.partitionBy("to_id").orderBy(F.desc("weight"), "from_id", "relation"))).where(F.col("_n") <= most_inbound).drop("_n")
    return users.unionByName(heavy).select(F.col("to_id").alias("target"), F.col("from_id").alias("node"), "relation").distinct()


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """a, b, jaccard: pairs taken in order of jaccard, then a and b, each side once.

    A pair that is first for both its sides is taken in the same round as all such; their sides leave.
    That gives what going through the sorted list gives. Rounds end when no pair is left.
    """
    tables, chosen = Tables(pairs.sparkSession, "matching"), None
    left = tables.written(pairs.select("a", "b", "jaccard"))
    while left.limit(1).count():
        order = [F.desc("jaccard"), "a", "b"]
        first = left.withColumns({"_a": F.row_number().over(W.partitionBy("a").orderBy(*order)), "_b": F.row_number().over(W.partitionBy("b").orderBy(*order))})
        taken = tables.written(first.where("_a = 1 and _b = 1").select("a", "b", "jaccard"))
        chosen = taken if chosen is None else chosen.union(taken)
        left = tables.written(left.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti"))
    return left if chosen is None else chosen
