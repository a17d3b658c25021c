"""Connected components by contraction: no driver-side links, hot vertices pre-aggregated, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for each vertex of edges (a, b: long) the smallest vertex it can reach.

    A round points each vertex at its smallest neighbour, follows that pointer once more, and keeps the distinct edges
    between what is left; pointers only go down, so the last label is the component's smallest vertex. A round writes its
    pointers and its edges; the labels follow from the pointers of all rounds. Joins read written tables, or what other
    joins gave, on both sides, so that Spark can split the partitions of a hub, to which many vertices point.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    labels, n = None, edges.count()  # no later table has more than twice as many rows
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(few(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m")), 2 * n), "cc-near")
        jump = near.join(near.select(F.col("v").alias("m"), F.col("m").alias("m2")), "m").select("v", F.col("m2").alias("m"))
        if labels is None:
            labels = jump.select("v", F.col("m").alias("label"))
        else:
            step = jump.select(F.col("v").alias("label"), F.col("m").alias("m"))
            labels = labels.join(step, "label", "left").select("v", F.coalesce("m", "label").alias("label"))
        x, y = jump.select(F.col("v").alias("a"), F.col("m").alias("p")), jump.select(F.col("v").alias("b"), F.col("m").alias("q"))
        edges = edges.join(x, "a").join(y, "b").filter("p <> q").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()
        edges = materialize(few(edges, n), "cc-edges")
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
    return materialize(few(labels, 2 * n), "cc-labels")
