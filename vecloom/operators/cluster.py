"""Centroids: fitting, assignment, statistics and incremental means."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import dot, l2sq, normalize

#: Largest centroid table that is broadcast; a larger one is joined in whatever way Spark chooses.
CENTROID_BYTES = 256 << 20


def held(centroids: DataFrame) -> DataFrame:
    """The centroid table read once and kept as local rows, if it is small enough to be broadcast; else as it is."""
    if getattr(centroids, "_held", False):
        return centroids
    n = centroids.agg(F.count("*").alias("rows"), F.max(F.size("centroid")).alias("wide")).first()
    if n.rows * (n.wide or 0) * 8 > CENTROID_BYTES:
        return centroids
    out = centroids.sparkSession.createDataFrame(centroids.collect(), centroids.schema)
    out._held = True
    return out


def small(centroids: DataFrame) -> DataFrame:
    """Broadcast hint for a centroid table whose size was checked."""
    table = held(centroids)
    return F.broadcast(table) if getattr(table, "_held", False) else centroids


def mean_vectors(rows: DataFrame, by: str) -> DataFrame:
    """by and centroid: the mean of embedding for each value of by, one partial sum a task and dimension."""
    each = rows.select(by, F.posexplode("embedding").alias("pos", "x"))
    means = each.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select(by, F.transform("s", lambda s: s["m"]).alias("centroid"))


def assign(rows: DataFrame, centroids: DataFrame, nearest: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, kept columns, cluster_id, dist, replica (0-based): the nearest centroids of each vector; ties to the smaller cluster.

    Distances are collected in one array a row and sorted there: no shuffle and no row for each pair.
    """
    near = small(centroids)
    table = near.groupBy().agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("cs"))
    one = rows.join(F.broadcast(table) if near is not centroids else table)
    ranked = F.array_sort(F.transform("cs", lambda c: F.struct(F.round(l2sq(F.col("embedding"), c["centroid"]), 6).alias("dist"), c["cluster_id"].alias("cluster_id"))))
    picked = one.select("vec_id", *keep, F.posexplode(F.slice(ranked, 1, nearest)).alias("replica", "x"))
    return picked.select("vec_id", *keep, "x.cluster_id", "x.dist", "replica")


def fit_kmeans(rows: DataFrame, k: int, seed: int = 42, max_iter: int = 50, inits: int = 1, unit: bool = True) -> tuple[DataFrame, float]:
    """Centroids (cluster_id, centroid) of the best of several fits, and its inertia.

    A fit that comes back with fewer than k centres gets the farthest vectors of its largest cluster as further ones.
    """
    spark = rows.sparkSession
    vectors = normalize(F.col("embedding")) if unit else F.col("embedding").cast("array<double>")
    data = rows.select("vec_id", vectors.alias("embedding")).withColumn("features", array_to_vector("embedding")).cache()
    try:
        fits = [KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=1e-4).fit(data) for i in range(inits)]
        model = min(fits, key=lambda m: m.summary.trainingCost)
        centres = [[float(x) for x in c] for c in model.clusterCenters()]

        def table() -> DataFrame:
            out = spark.createDataFrame(list(enumerate(centres)), "cluster_id int, centroid array<double>")
            if sum(map(len, centres)) * 8 <= CENTROID_BYTES:
                out._held = True  # local rows already
            return out

        if len(centres) < k:
            near = assign(data, table(), keep=("embedding",))
            largest = near.groupBy("cluster_id").count().orderBy(F.desc("count"), "cluster_id").first()
            if largest:
                far = near.where(F.col("cluster_id") == largest.cluster_id).orderBy(F.desc("dist"), "vec_id").limit(k - len(centres))
                centres += [r.embedding for r in far.select("embedding").collect()]
        return table(), float(model.summary.trainingCost)
    finally:
        data.unpersist()


def lloyd_step(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """cluster_id, n, centroid after one round; a cluster without vectors keeps its centroid, n = 0."""
    near = assign(rows, centroids, keep=("embedding",))
    new = mean_vectors(near, "cluster_id").join(near.groupBy("cluster_id").count(), "cluster_id")
    both = centroids.withColumnRenamed("centroid", "old").join(new, "cluster_id", "left")
    return both.select("cluster_id", F.coalesce("count", F.lit(0)).alias("n"), F.coalesce("centroid", "old").alias("centroid"))


def cluster_sizes(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    return centroids.select("cluster_id").join(assigned.groupBy("cluster_id").count(), "cluster_id", "left").select("cluster_id", F.coalesce("count", F.lit(0)).alias("n"))


def size_statistics(sizes: DataFrame) -> DataFrame:
    """clusters, empty, least (of those that are not empty), most, mean (over all)."""
    n = F.col("n")
    return sizes.agg(F.count("*").alias("clusters"), F.count_if(n == 0).alias("empty"), F.min(F.when(n > 0, n)).alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.round(F.sum("dist"), 4).alias("inertia"))


def running_mean(centroids: DataFrame, added: DataFrame) -> DataFrame:
    """centroids (cluster_id, n, centroid) after vectors (cluster_id, embedding) came in: (n*c + sum) / (n + m)."""
    each = added.select("cluster_id", F.posexplode("embedding").alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("m"))
    sums = each.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("s"), F.max("m").alias("m"))
    # A name of its own: inside a lambda, n would be taken for the output column of that name.
    total = F.col("had") + F.col("m")
    moved = F.zip_with("centroid", "s", lambda c, s: (c * F.col("had") + s["s"]) / total)
    both = centroids.withColumnRenamed("n", "had").join(sums, "cluster_id", "left")
    return both.select("cluster_id", F.coalesce(total, F.col("had")).alias("n"), F.when(F.col("m").isNotNull(), moved).otherwise(F.col("centroid")).alias("centroid"))


def centroid_scores(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """query_id, cluster_id, score, r: inner product with each centroid, ranked; ties to the smaller cluster."""
    s = queries.crossJoin(small(centroids)).select("query_id", "cluster_id", F.round(dot(F.col("embedding"), F.col("centroid")), 6).alias("score"))
    return s.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "cluster_id")))


def weighted_pick(rows: DataFrame, centroids: DataFrame, u: float, block: int = 1000) -> DataFrame:
    """The row that k-means++ draws next: the first by vec_id at which the running sum of squared distances to the nearest centroid reaches u times their total.

    Sums of blocks of ids come first, so that only one block is put in order.
    """
    d = assign(rows, centroids).select("vec_id", "dist", F.floor(F.col("vec_id") / block).alias("block"))
    sums = d.groupBy("block").agg(F.sum("dist").alias("s"))
    upto = sums.withColumn("upto", F.sum("s").over(W.orderBy("block"))).withColumn("goal", F.sum("s").over(W.partitionBy()) * F.lit(float(u)))
    hit = upto.where(F.col("upto") >= F.col("goal")).orderBy("block").limit(1).select("block", (F.col("goal") - F.col("upto") + F.col("s")).alias("rest"))
    inside = d.join(hit, "block").withColumn("run", F.sum("dist").over(W.partitionBy("block").orderBy("vec_id")))
    return inside.where(F.col("run") >= F.col("rest") - 1e-9).orderBy("vec_id").limit(1).select("vec_id")
