"""Search trees as adjacency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize
from .metrics import r6


def children(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, n_children)."""
    return nodes.filter("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, depth, path): root to node, the ids joined by '>'.

    By pointer doubling: each round puts a node's path so far behind that of the node it points at, and points where that
    one does, so a tree of depth d takes log2(d) + 1 rounds, each a written table. Nodes that no root reaches are left out.
    """
    root = F.col("parent_id").isNull()
    t = nodes.select("tree_id", "node_id", F.col("parent_id").alias("up"), F.when(root, 0).otherwise(1).alias("depth"), F.col("node_id").cast("string").alias("path"))
    t = materialize(t, "tree-paths")
    reach, n = 1, t.count()
    while reach <= 2 * n and t.filter("up is not null").limit(1).count():  # beyond it what is left runs in circles
        above = t.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("path").alias("before"))
        longer = t.filter("up is not null").join(above, ["tree_id", "up"]).select("tree_id", "node_id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat_ws(">", "before", "path").alias("path"))
        t, reach = materialize(t.filter("up is null").unionByName(longer), "tree-paths"), 2 * reach
    return t.filter("up is null").drop("up")


def at_depth(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of a depth that aren't terminal."""
    return paths(nodes).filter(F.col("depth") == depth).join(nodes.filter(~F.col("terminal")), ["tree_id", "node_id"], "left_semi")


def top_children(nodes: DataFrame, k: int, weight: float) -> DataFrame:
    """The k best children of each node by reward + weight * diversity."""
    score = F.round(F.col("reward") + weight * F.col("diversity"), 6)
    w = Window.partitionBy("tree_id", "parent_id").orderBy(F.desc("score"), "node_id")
    return nodes.filter("parent_id is not null").withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("tree_id", "parent_id", "node_id", "score", "rank")


def solution_reward(nodes: DataFrame) -> DataFrame:
    """A solution's reward is the least over its path; means over each tree's leaves."""
    p = paths(nodes).select("tree_id", F.col("node_id").alias("leaf"), F.explode(F.split("path", ">")).alias("node_id")).withColumn("node_id", F.col("node_id").cast("long"))
    leaves = nodes.join(children(nodes), ["tree_id", "node_id"], "left_anti").select("tree_id", F.col("node_id").alias("leaf"))
    t = p.join(leaves, ["tree_id", "leaf"]).join(nodes.select("tree_id", "node_id", "reward", "diversity"), ["tree_id", "node_id"])
    per = t.groupBy("tree_id", "leaf").agg(F.min("reward").alias("reward"), F.avg("diversity").alias("diversity"))
    return per.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n_solutions"), r6(F.avg("reward"), "mean_reward"), r6(F.avg("diversity"), "mean_diversity"), F.max_by("leaf", F.struct("reward", -F.col("leaf"))).alias("best_leaf"))


def sibling_diversity(nodes: DataFrame, value: str) -> DataFrame:
    """G05's frame: each non-terminal sibling against the mean of its other siblings; lone ones have 0."""
    t = nodes.filter("parent_id is not null and not terminal")
    g = t.groupBy("tree_id", "parent_id").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    gap = F.when(F.col("n") < 2, 0.0).otherwise(F.abs(F.col(value) - F.try_divide(F.col("s") - F.col(value), F.col("n") - 1)))
    return t.join(g, ["tree_id", "parent_id"]).select("tree_id", "node_id", r6(gap, "gap"))
