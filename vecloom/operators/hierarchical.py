"""Searches over sealed rows in signature buckets: one level, two levels (super and sub), and hybrid.

Rows lie in a BlobTable, sealed under their id. A search asks for buckets, decoys among them, fetches all of
them, drops what decoys brought, decrypts and scores. Keys of two-level buckets read "super_sub".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import crypt
from ..functions.vectors import grid, hyperplane_signature
from . import lsh, privacy
from .blobs import BlobTable
from .cluster import centroid_scores
from .probe import strict
from .scan import block_scan, scorer, top_k


def bucket_key(super_id: Column, sub_id: Column) -> Column:
    return F.format_string("%02d_%02d", super_id, sub_id)


def parse_key(key: Column) -> Column:
    """Struct of super and sub; null for what is no key."""
    ok = key.rlike(r"^\d+_\d+$")
    part = lambda i: F.when(ok, F.split_part(key, F.lit("_"), F.lit(i)).cast("int"))
    return F.struct(part(1).alias("super"), part(2).alias("sub"))


def _seal(rows: DataFrame, key: bytes) -> DataFrame:
    """blob_id, bucket, ciphertext, version of rows (vec_id, embedding, bucket)."""
    rows = rows.select(F.col("vec_id").cast("string").alias("blob_id"), F.col("bucket").cast("int").alias("bucket"), F.col("embedding").cast("array<float>").alias("embedding"))
    raw = crypt.with_bytes(rows, "embedding", "raw")
    return raw.select("blob_id", "bucket", crypt.encrypt(F.col("raw"), key, F.col("blob_id")).alias("ciphertext"), F.lit(1).cast("long").alias("version"))


class BucketIndex:
    """One level: the bucket is the signature. Search looks into the query's own bucket and those one flipped bit away."""

    def __init__(self, store: BlobTable, planes: list[list[float]], key: bytes):
        self.store, self.planes, self.key = store, planes, key

    def bucket_of(self, v: Column) -> Column:
        return hyperplane_signature(v, self.planes).cast("int")

    def insert(self, rows: DataFrame) -> None:
        self.store.put(_seal(rows.select("vec_id", "embedding", self.bucket_of(F.col("embedding")).alias("bucket")), self.key))

    def delete(self, ids: DataFrame) -> int:
        return self.store.delete(ids.select(F.col("vec_id").cast("string").alias("blob_id")))

    def stats(self) -> DataFrame:
        return self.store.stats()

    def asked(self, queries: DataFrame, flips: int, decoys: int) -> DataFrame:
        """query_id, bucket, real."""
        own = queries.select("query_id", self.bucket_of(F.col("embedding")).alias("b"))
        near = [F.col("b")] + [F.col("b").bitwiseXOR(F.lit(1 << i)) for i in range(flips)]
        real = own.select("query_id", F.explode(F.array(*near)).alias("bucket"))
        out = real.withColumn("real", F.lit(True))
        if decoys:
            out = out.unionByName(privacy.existing_decoys(real, self.store.list_buckets(), decoys, "bucket").withColumn("real", F.lit(False)))
        return out

    def search(self, queries: DataFrame, k: int = 10, flips: int = 0, decoys: int = 0) -> DataFrame:
        """query_id, vec_id, score, rank."""
        return _searched(self.store, self.key, queries, self.asked(queries, flips, decoys), k)

    def hybrid(self, queries: DataFrame, k: int = 10, fine: int = 20, flips: int = 4, decoys: int = 0, bits: int = 10) -> DataFrame:
        """Exact scores pick `fine` candidates, whose scores on the grid of an encrypted evaluation decide."""
        coarse = self.search(queries, fine, flips, decoys).drop("rank")
        return top_k(coarse.withColumn("score", grid(F.col("score"), bits)), k, ties=F.col("vec_id"))


def _searched(store: BlobTable, key: bytes, queries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Fetch all asked buckets, drop decoys' rows after the fetch, decrypt each row once for all queries, score, keep the best k."""
    places = asked.groupBy("bucket").agg(F.bool_or("real").alias("real"))
    fetched = places.join(store.rows, "bucket").where(F.when(F.col("blob_id").isNotNull(), F.col("real")))
    plain = fetched.select(F.col("blob_id").alias("vec_id"), crypt.bytes_to_vector(crypt.decrypt(F.col("ciphertext"), key, F.col("blob_id"))).alias("embedding"), "bucket").where("embedding is not null")
    return block_scan(queries, plain, "embedding", scorer(), k, "score", False, T.DoubleType(), asked.where("real").select("query_id", "bucket"), "bucket")


class TwoLevelIndex:
    """Super-buckets have centroids, sub-buckets are signatures within them; a stored bucket is super * subs + sub."""

    def __init__(self, store: BlobTable, super_planes: list[list[float]], sub_planes: list[list[float]], supers: int, subs: int, key: bytes):
        self.store, self.super_planes, self.sub_planes, self.supers, self.subs, self.key = store, super_planes, sub_planes, supers, subs, key
        self.centroids: DataFrame | None = None

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows with super and sub."""
        v = F.col("embedding")
        place = lambda planes, n: lsh.bucket(hyperplane_signature(v, planes), n)
        return rows.withColumn("super", place(self.super_planes, self.supers)).withColumn("sub", place(self.sub_planes, self.subs))

    def build(self, rows: DataFrame) -> None:
        placed = self.placed(rows.select("vec_id", "embedding"))
        self.store.put(_seal(placed.withColumn("bucket", F.col("super") * self.subs + F.col("sub")), self.key))
        self.centroids = lsh.bucket_centroids(rows, self.super_planes, self.supers).withColumnRenamed("bucket", "cluster_id")

    def super_rows(self, *supers: int) -> DataFrame:
        """All rows of some super-buckets, in folders pruned by bucket."""
        return self.store.bucket(*(s * self.subs + i for s in supers for i in range(self.subs)))

    def asked(self, queries: DataFrame, top: int, neighbours: int, decoys: int, seed: int = 1) -> DataFrame:
        """query_id, bucket, real: the query's sub-bucket and its neighbours in the best super-buckets, and drawn decoys."""
        probed = strict(centroid_scores(queries, self.centroids), top).withColumnRenamed("cluster_id", "super")
        own = self.placed(queries.select("query_id", "embedding")).select("query_id", "sub")
        near = lsh.neighbour_buckets(F.col("sub"), min(neighbours + 1, self.subs), self.subs)
        real = probed.join(own, "query_id").select("query_id", "super", F.explode(near).alias("sub"))
        drawn = privacy.drawn_decoys(probed, self.supers, self.subs, decoys, seed).distinct()
        both = real.withColumn("real", F.lit(True)).unionByName(drawn.withColumn("real", F.lit(False)))
        return both.select("query_id", (F.col("super") * self.subs + F.col("sub")).cast("int").alias("bucket"), "real")

    def search(self, queries: DataFrame, k: int = 10, top: int = 3, neighbours: int = 1, decoys: int = 0) -> DataFrame:
        return _searched(self.store, self.key, queries, self.asked(queries, top, neighbours, decoys), k)
