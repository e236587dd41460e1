"""Recall, ranking quality, cluster coverage and latency figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, hits, recall at k; both sides have query_id, vec_id, rank."""
    good = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    hits = found.where(F.col("rank") <= k).join(good, ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    every = good.select("query_id").distinct().join(hits, "query_id", "left")
    return every.select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce("hits", F.lit(0)) / float(k), 6).alias("recall"))


def ndcg(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg: relevance of a true neighbour is k - rank + 1, discounted by log2(rank + 1)."""
    rel = truth.where(F.col("rank") <= k).select("query_id", "vec_id", (F.lit(k) - F.col("rank") + 1).alias("rel"))
    ideal = truth.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum((F.lit(k) - F.col("rank") + 1) / F.log2(F.col("rank") + F.lit(1.0))).alias("ideal"))
    got = found.where(F.col("rank") <= k).join(rel, ["query_id", "vec_id"]).groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + F.lit(1.0))).alias("got"))
    return ideal.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("got", F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))


def coverage(truth: DataFrame, assigned: DataFrame, probed: DataFrame) -> DataFrame:
    """query_id, covered: share of true neighbours whose cluster is probed."""
    where = truth.join(assigned.select("vec_id", "cluster_id"), "vec_id").select("query_id", "vec_id", "cluster_id")
    hit = where.join(probed.withColumn("hit", F.lit(1)), ["query_id", "cluster_id"], "left")
    best = hit.groupBy("query_id", "vec_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return best.groupBy("query_id").agg(F.round(F.avg("hit"), 6).alias("covered"))


def latency(log: DataFrame) -> DataFrame:
    """avg, p50, p95, p99, least and most of ms."""
    p = lambda q: F.percentile("ms", F.lit(q))
    return log.agg(F.avg("ms").alias("avg"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min("ms").alias("least"), F.max("ms").alias("most"))
