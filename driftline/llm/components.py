"""Connected components of an undirected graph of any size, by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the least node of its component.

    Each round takes the least label among a node's neighbours and then the label of its label, so
    rounds grow with the logarithm of the longest path.  A node with any number of edges is
    one side of equality joins that Spark may split, and of sums that start before the shuffle.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = cut_lineage(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("label")))
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        step = cut_lineage(labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                            F.least("label", "near").alias("label")))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = cut_lineage(step.join(up, "label").select("node", "old", F.col("top").alias("label")))
        if labels.where("label <> old").limit(1).count() == 0:
            return labels.select("node", "label")
