"""Who computes scores of queries against centroids, behind one interface.

PlainProvider gives the scores that an encrypted evaluation would decode to, on the same grid, without
the privacy of the query: no library for homomorphic encryption is available here.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import grid
from .cluster import centroid_scores


class ScoreProvider(Protocol):
    def scores(self, queries: DataFrame, centroids: DataFrame) -> DataFrame:
        """query_id, cluster_id, score, r (rank)."""


class PlainProvider:
    def __init__(self, bits: int = 0):
        self.bits = bits

    def scores(self, queries: DataFrame, centroids: DataFrame) -> DataFrame:
        plain = centroid_scores(queries, centroids)
        if not self.bits:
            return plain
        coarse = plain.withColumn("score", grid(F.col("score"), self.bits))
        return coarse.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "cluster_id")))


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id, same: share of the first k clusters that two providers have in common."""
    both = a.where(F.col("r") <= k).select("query_id", "cluster_id").join(b.where(F.col("r") <= k).select("query_id", "cluster_id", F.lit(1).alias("hit")), ["query_id", "cluster_id"], "left")
    return both.groupBy("query_id").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / float(k), 6).alias("same"))
