"""Connected components by hooking and pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.storage import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node that can be reached.

    Self-loops name isolated nodes; edges may repeat and go either way. Each round hooks the label of every node's
    component to the smallest label among its neighbours and shortens the chains, so rounds grow with the logarithm of
    the longest path in practice; intermediate tables are written to the shared folder. Edges must be settled.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        # contract: edges between the labels themselves
        left = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
        right = labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
        between = settle(
            both.where("a < b").join(left, "a").join(right, "b").where("la != lb")
            .select(F.greatest("la", "lb").alias("high"), F.least("la", "lb").alias("low"))
            .union(labels.where("component != node").join(labels.select(F.col("node").alias("component"), F.col("component").alias("up")), "component").where("up != component").select(F.col("component").alias("high"), F.col("up").alias("low")))
            .distinct()
        )
        if between.isEmpty():
            discard(between)
            return labels
        hooks = between.groupBy("high").agg(F.min("low").alias("low"))
        again = hooks.select(F.col("high").alias("low"), F.col("low").alias("lower"))
        jump = hooks.join(again, "low", "left").select("high", F.coalesce("lower", "low").alias("low"))
        after = settle(labels.join(jump, labels["component"] == jump["high"], "left").select("node", F.coalesce("low", "component").alias("component")))
        discard(labels, between)
        labels = after
