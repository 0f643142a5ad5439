"""Connected components of a link table, each labelled by its smallest id."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwise.llm.common import checkpointed


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``id`` and ``component_id`` of every id that occurs in ``links``.

    Every round takes the smallest label among neighbours, then the label of the label; the rounds are about
    the logarithm of the longest path.  All of it is joins and minima, and the labels stay distributed.
    """
    both = links.select(F.col(left).alias("u"), F.col(right).alias("v"))
    both = checkpointed(both.union(both.select("v", "u")).distinct())
    labels = both.select(F.col("u").alias("id")).distinct().withColumn("component_id", F.col("id"))
    # The first round needs no join: a node's label is the smallest of its neighbours.
    near = both.groupBy("u").agg(F.min("v").alias("n"))
    labels = checkpointed(near.select(F.col("u").alias("id"), F.least("u", "n").alias("component_id")))
    while True:
        old = labels
        near = (
            both.join(old, both.v == old.id).groupBy("u").agg(F.min("component_id").alias("n"))
        )
        lower = old.join(near, old.id == near.u, "left").select(
            "id", F.least("component_id", F.coalesce("n", "component_id")).alias("low"), "component_id"
        )
        up = lower.select(F.col("id").alias("up"), F.col("low").alias("up_low"))
        labels = checkpointed(
            lower.join(up, lower.low == up.up, "left").select(
                "id", F.least("low", F.coalesce("up_low", "low")).alias("new"), "component_id"
            )
        )
        moved = labels.where("new < component_id")
        done = moved.isEmpty()
        labels = labels.select("id", F.col("new").alias("component_id"))
        if done:
            return labels
