"""Operators on graphs given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topotide.plans.scratch import new_path, remove, written


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components: one row (node, component) per node of ``edges``.

    ``component`` is the smallest node that can be reached.  Each round takes
    the smallest label among the neighbours and then the label of the label
    (pointer jumping), so that long chains close in few rounds.  Labels are
    written to the shared folder after each round; the rounds end when none
    changed.  Null ends are ignored; repeated edges and loops do no harm.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    both = written(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    path = new_path(spark, "labels")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels", path)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("over"))
        step = lower.join(jump, "component").select("node", "old", F.least("component", "over").alias("component"))
        next_path = new_path(spark, "labels")
        moved = written(step, "labels", next_path)
        remove(spark, path)
        path, labels = next_path, moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels
