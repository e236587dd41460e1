"""Dummy queries among real ones, and what a log of queries tells about their privacy."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalize
from ..sources.datasets import uniform


def with_dummies(queries: DataFrame, dimension: int, share: float, seed: int = 3) -> DataFrame:
    """queries (query_id, embedding) and `real`, with one dummy beside about `share` of them.

    A dummy is a seeded unit vector under the id of its real query; drop rows that are not real from results.
    """
    lucky = F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda j: uniform(F.xxhash64("query_id"), j, seed))
    real = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(True).alias("real"))
    return real.unionByName(queries.where(lucky).select("query_id", normalize(raw).alias("embedding"), F.lit(False).alias("real")))


def privacy_metrics(log: DataFrame) -> DataFrame:
    """log: real (boolean), probed, decoys, ms for each query. One row of totals, shares and means."""
    return log.agg(
        F.count_if("real").alias("real"), F.count_if(~F.col("real")).alias("dummies"), F.sum("probed").alias("probed"), F.sum("decoys").alias("decoys"),
        F.try_divide(F.sum("decoys"), F.sum(F.col("probed") + F.col("decoys"))).alias("decoy_share"), F.avg("ms").alias("mean_ms"),
    )


def unhurried(search: Callable, least: float, jitter: float = 0.0, draw: Callable[[], float] = random.SystemRandom().random, sleep: Callable[[float], None] = time.sleep):
    """search with answers that come no sooner than `least` seconds, plus up to `jitter` more, so that its time tells little."""

    def run(*args, **options):
        begun = time.monotonic()
        out = search(*args, **options)
        sleep(max(0.0, least - (time.monotonic() - begun)) + jitter * draw())
        return out

    return run
