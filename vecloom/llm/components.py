"""Connected components of a link table, without a graph library and without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, label: the smallest node reachable.

    Every round takes the smallest label of the neighbours and then follows labels of labels, so the
    number of rounds grows with the logarithm of the longest path. Labels are minima: hot nodes are
    aggregated before the shuffle.
    """
    edges = checkpointed(links.select("a", "b").where("a <> b").distinct())
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    labels = checkpointed(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.toDF("other", "far"), "other").groupBy("node").agg(F.min("far").alias("far"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "far").alias("new"))
        jump = step.join(labels.toDF("new", "up"), "new", "left").select("node", "label", F.least("new", F.coalesce("up", "new")).alias("new"))
        jump = checkpointed(jump)
        moved = jump.where("new <> label").limit(1).count()
        labels = jump.select("node", F.col("new").alias("label"))
        if not moved:
            return labels
