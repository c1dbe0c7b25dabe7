"""Connected components of an edge table by repeated minimum labels with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.session import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for nodes of undirected ``edges(a, b)``: the smallest node reachable.

    Each round a node takes the least label among itself and its neighbours, then the label of
    that label; rounds end when no label falls. Labels are aggregated before they move.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")))
    while True:
        offered = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        lower = labels.join(offered, "a").select("a", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = lower.select(F.col("a").alias("l"), F.col("l").alias("next"))
        following = checkpointed(lower.join(jump, "l", "left").select("a", "old", F.least("l", F.coalesce("next", "l")).alias("l")))
        if following.filter("l < old").isEmpty():
            return following.select(F.col("a").alias("node"), F.col("l").alias("component"))
        labels = following.select("a", "l")
