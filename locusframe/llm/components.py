"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import write_shared


def components(links: DataFrame, path: str) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b): the smallest node it reaches.

    Each round lowers the label of a node to the smallest among its
    neighbours' (partial aggregation: a hub's links are combined before the
    shuffle), hooks the old label's root to it, and jumps along labels. Every
    round is written to ``path``, so a lost executor costs one round at most.
    """
    both = write_shared(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(),
        f"{path}/links",
    )
    labels = write_shared(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{path}/labels-0")
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b")
            .groupBy("a")
            .agg(F.min("other").alias("other"))
        )
        lowered = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "other").alias("low"))
        # A node's old label learns of the smaller label too.
        hook = lowered.where("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hooked"))
        merged = write_shared(
            lowered.join(hook, "node", "left").select("node", F.least("low", F.coalesce("hooked", "low")).alias("label"), F.col("label").alias("was")),
            f"{path}/hooked-{turn}",
        )
        jump = merged.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = write_shared(
            merged.join(jump, "label").select("node", F.least("label", "root").alias("label"), "was"),
            f"{path}/labels-{turn}",
        )
        if not new.where("label != was").head(1):
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
