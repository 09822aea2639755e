"""Connected components of a graph of links, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each end of ``links`` (a, b) reaches.

    Every round takes the smallest label among a node's neighbours and then the label of that
    label, so chains shorten by half at least. Each round is written to the shared folder.
    Links of a node to itself and repeated links do no harm; nulls are ignored.
    """
    links = links.where("a is not null and b is not null and a != b").select("a", "b")
    both = scratch.table(links.union(links.select("b", "a")).distinct(), "links")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        now = scratch.table(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        moved = now.where("old != label").limit(1).count()
        labels = now.select("node", "label")
        if not moved:
            return labels
