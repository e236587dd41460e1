"""Which clusters a query probes: fixed number, score threshold or gap between scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

def _by_query():
    return W.partitionBy("query_id")


def strict(ranked: DataFrame, least: int) -> DataFrame:
    return ranked.where(F.col("r") <= least).select("query_id", "cluster_id")


def threshold(ranked: DataFrame, least: int, most: int = 0, t: float = 0.95) -> DataFrame:
    """The best `least`, and up to `most` whose score reaches t times the least-th (over t for a negative one).

    t outside (0, 1) means the best `least` only; most below 1 means least.
    """
    if t <= 0 or t >= 1:
        return strict(ranked, least)
    most = most if most > 0 else least
    edge = F.max(F.when(F.col("r") == least, F.col("score"))).over(_by_query())
    limit = F.when(edge >= 0, edge * F.lit(float(t))).otherwise(edge / F.lit(float(t)))
    keep = (F.col("r") <= least) | ((F.col("r") <= most) & (F.col("score") >= F.col("limit")))
    return ranked.withColumn("limit", limit).where(keep).select("query_id", "cluster_id")


def gap(ranked: DataFrame, least: int, most: int, multiplier: float = 2.0) -> DataFrame:
    """From the least-th on, up to the first gap that is over multiplier times the query's median gap."""
    order = _by_query().orderBy("r")
    steps = ranked.where(F.col("r") <= most).withColumn("gap", F.when(F.col("r") > least, F.lag("score").over(order) - F.col("score")))
    middle = steps.groupBy("query_id").agg(F.percentile("gap", F.lit(0.5)).alias("middle"))
    wide = (F.col("middle") > 1e-12) & (F.col("gap") > F.col("middle") * F.lit(float(multiplier)))
    stop = F.min(F.when(wide, F.col("r"))).over(_by_query())
    return steps.join(middle, "query_id").withColumn("stop", stop).where((F.col("r") <= least) | (F.col("r") < F.coalesce("stop", F.lit(most + 1)))).select("query_id", "cluster_id")
