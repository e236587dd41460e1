"""What hides access patterns: decoy buckets, bucket permutation and padding. None of it changes results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.crypt import blob_size


def decoy_count(epsilon: float, clusters: int, probed: int) -> int:
    """ceil((clusters - probed) * e**-epsilon); 0 without a pool or for epsilon <= 0, else at least 1."""
    pool = clusters - probed
    if epsilon <= 0 or pool <= 0:
        return 0
    return min(pool, max(1, math.ceil(pool * math.exp(-epsilon))))


def uniform_decoys(probed: DataFrame, clusters: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """query_id, cluster_id: exactly `count` clusters that the query does not probe (fewer if there are fewer)."""
    rest = _rest(probed, clusters)
    order = W.partitionBy("query_id").orderBy(F.xxhash64("query_id", "cluster_id", F.lit(seed)), "cluster_id")
    return rest.withColumn("r", F.row_number().over(order)).where(F.col("r") <= count).select("query_id", "cluster_id")


def bernoulli_decoys(probed: DataFrame, clusters: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """Each cluster that is not probed, on its own with probability count / pool."""
    rest = _rest(probed, clusters)
    pool = F.count("*").over(W.partitionBy("query_id"))
    draw = F.pmod(F.xxhash64("query_id", "cluster_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rest.withColumn("p", F.lit(float(count)) / pool).where(draw < F.col("p")).select("query_id", "cluster_id")


def _rest(probed: DataFrame, clusters: DataFrame) -> DataFrame:
    return probed.select("query_id").distinct().join(clusters.select("cluster_id")).join(probed, ["query_id", "cluster_id"], "left_anti")


def permutation(clusters: DataFrame, seed: int = 7) -> DataFrame:
    """cluster_id, bucket: a seeded bijection of the cluster ids 0..n-1 (as many rows as there are clusters)."""
    order = W.orderBy(F.xxhash64("cluster_id", F.lit(seed)), "cluster_id")
    return clusters.select("cluster_id", (F.row_number().over(order) - 1).alias("bucket"))


def to_storage(rows: DataFrame, pi: DataFrame | None) -> DataFrame:
    """bucket for cluster_id by the permutation; the identity where there is none."""
    if pi is None:
        return rows.withColumn("bucket", F.col("cluster_id"))
    named = pi.select(F.col("cluster_id").alias("_c"), F.col("bucket").alias("_b"))
    return rows.join(F.broadcast(named), F.col("cluster_id") == F.col("_c"), "left").withColumn("bucket", F.coalesce("_b", "cluster_id")).drop("_c", "_b")


def padding_targets(counts: DataFrame, mode: str = "bucketed") -> DataFrame:
    """bucket, n, target: the next power of two of each bucket, or the largest count for all (max)."""
    if mode == "max":
        return counts.withColumn("target", F.max("n").over(W.partitionBy()))
    power = F.when(F.col("n") > 0, F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")) - 1e-12))).otherwise(F.lit(0.0))
    return counts.withColumn("target", power.cast("long"))


def random_bytes(size: int) -> Column:
    """So many bytes that look like any ciphertext: hashes of a fresh random id."""
    parts = F.transform(F.sequence(F.lit(1), F.lit(-(-size // 32))), lambda i: F.sha2(F.concat("_draw", i.cast("string")), 256))
    return F.substring(F.unhex(F.array_join(parts, "")), 1, size)


def padding(counts: DataFrame, dimension: int, mode: str = "bucketed") -> DataFrame:
    """bucket, blob_id, ciphertext: random rows that bring each bucket to its target; they never decrypt."""
    short = padding_targets(counts, mode).where(F.col("target") > F.col("n"))
    each = short.select("bucket", F.explode(F.sequence(F.lit(1).cast("long"), F.col("target") - F.col("n"))))
    drawn = each.select("bucket", F.concat(F.uuid(), F.uuid()).alias("_draw"))
    return drawn.select("bucket", F.sha2("_draw", 256).alias("blob_id"), random_bytes(blob_size(dimension)).alias("ciphertext"))


def existing_decoys(probed: DataFrame, buckets: DataFrame, count: int, by: str = "cluster_id", seed: int = 1) -> DataFrame:
    """query_id and bucket: `count` buckets that hold rows and that the query does not ask for, in a seeded order."""
    rest = probed.select("query_id").distinct().join(buckets.select(by).distinct()).join(probed.select("query_id", by), ["query_id", by], "left_anti")
    order = W.partitionBy("query_id").orderBy(F.xxhash64("query_id", by, F.lit(seed)), by)
    return rest.withColumn("r", F.row_number().over(order)).where(F.col("r") <= count).select("query_id", by)


def drawn_decoys(probed: DataFrame, supers: int, subs: int, count: int, seed: int = 1) -> DataFrame:
    """query_id, super, sub: `count` draws with replacement among super-buckets that the query does not probe."""
    taken = probed.groupBy("query_id").agg(F.collect_set("super").alias("taken"))
    rest = taken.select("query_id", F.array_except(F.sequence(F.lit(0), F.lit(supers - 1)), "taken").alias("rest")).where(F.size("rest") > 0)
    each = rest.select("query_id", "rest", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("i")) if count > 0 else rest.select("query_id", "rest", F.lit(0).alias("i")).limit(0)
    draw = lambda salt, n: F.pmod(F.xxhash64("query_id", "i", F.lit(seed + salt)), n).cast("int")
    return each.select("query_id", F.get("rest", draw(0, F.size("rest"))).alias("super"), draw(1, F.lit(subs)).alias("sub"))


def shuffled(rows: DataFrame, seed: int | None = None) -> DataFrame:
    """The same rows in random order, so that order tells nothing about what is real."""
    return rows.orderBy(F.rand(seed))


def epsilon_table(spark: SparkSession, cases: list[tuple[int, int, float]]) -> DataFrame:
    return spark.createDataFrame([(n, k, e, decoy_count(e, n, k)) for n, k, e in cases], "clusters int, probed int, epsilon double, decoys int")
