"""Inverted-file search: probe clusters, join their vectors, score, keep the best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import assign, centroid_scores, fit_kmeans, held
from .probe import gap, strict, threshold
from .scan import block_scan, scorer


def probes(queries: DataFrame, centroids: DataFrame, least: int = 4, most: int = 8, strategy: str = "threshold", t: float = 0.95, multiplier: float = 2.0, ranked: DataFrame | None = None) -> DataFrame:
    """query_id, cluster_id to look into; ranked: scores of another provider in place of plain ones."""
    ranked = centroid_scores(queries, centroids) if ranked is None else ranked
    if strategy == "threshold":
        return threshold(ranked, least, most, t)
    if strategy == "gap":
        return gap(ranked, least, most, multiplier)
    return strict(ranked, least)


def search(queries: DataFrame, stored: DataFrame, probed: DataFrame, k: int = 10, replicas: int = 1) -> DataFrame:
    """query_id, vec_id, score, rank: best k over the probed clusters; a vector in several of them counts once.

    stored: vec_id, embedding, cluster_id, at most `replicas` rows a vector. Each block of queries goes to the rows, which
    meet those that probe their cluster as matrices; only the best k * replicas of each query and task are shuffled.
    Where probed has a column `real`, rows that decoys brought are dropped after they were read.
    """
    if "real" in probed.columns:
        places = probed.groupBy("cluster_id").agg(F.bool_or("real").alias("real"))
        stored = stored.join(F.broadcast(places), "cluster_id").where(F.when(F.col("vec_id").isNotNull(), F.col("real")))
        probed = probed.where("real")
    return block_scan(queries, stored, "embedding", scorer(), k, "score", False, T.DoubleType(), probed.select("query_id", "cluster_id"), copies=replicas)


def build(rows: DataFrame, clusters: int, replicas: int = 1, seed: int = 42, sample: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(centroids, rows with their embedding and cluster). The centroids may be fitted on a share of the rows; every row is assigned."""
    centroids, _ = fit_kmeans(rows if sample is None else rows.sample(sample, seed), clusters, seed)
    return held(centroids), assign(rows, centroids, replicas, keep=("embedding",))
