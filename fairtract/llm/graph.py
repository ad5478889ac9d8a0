"""Connected components of large sparse graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtract.llm.storage import drop, stage


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links to ``node, component``: the smallest node that can be reached.

    Labels go along links and along themselves (a node takes its label's label)
    until none changes, so long chains halve in each round. Each round is
    written; only the number of changes reaches the driver. Nodes without
    links are not returned.
    """
    both = stage(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .where("node <> other")
        .distinct(),
        "links",
    )
    labels = stage(
        both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "other"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("near"))
        )
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        moved = stage(
            labels.join(near, "node")
            .join(own, "component")
            .select("node", F.least("component", "near", "jump").alias("component"), (F.least("near", "jump") < F.col("component")).alias("moved")),
            "labels",
        )
        drop(labels)
        labels = moved.select("node", "component")
        if not moved.where("moved").head(1):
            drop(both)
            return labels
