"""A table of encrypted rows by bucket: point and bucket reads, inserts, deletes and statistics.

Rows: blob_id, bucket, ciphertext, version. The table is Parquet partitioned by bucket, so bucket reads
prune to their folders, also when the buckets come from a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyExists

SCHEMA = "blob_id string, bucket int, ciphertext binary, version long"


class BlobTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def rows(self) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def put(self, rows: DataFrame) -> None:
        """All or nothing: an id that is there already, or twice among the new rows, refuses the whole batch."""
        rows = rows.select("blob_id", F.col("bucket").cast("int").alias("bucket"), "ciphertext", F.col("version").cast("long").alias("version"))
        if not rows.groupBy("blob_id").count().where("count > 1").isEmpty() or not rows.join(self.rows.select("blob_id"), "blob_id", "left_semi").isEmpty():
            raise AlreadyExists("blob id")
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def get(self, ids: DataFrame) -> DataFrame:
        """One row for each asked blob_id; nulls where it is missing."""
        return ids.select("blob_id").join(self.rows, "blob_id", "left")

    def bucket(self, *buckets: int) -> DataFrame:
        return self.rows.where(F.col("bucket").isin(*buckets)).dropDuplicates(["blob_id"])

    def buckets_of(self, wanted: DataFrame) -> DataFrame:
        """Rows of the buckets in wanted (bucket); folders are pruned while the query runs."""
        return self.rows.join(wanted.select("bucket").distinct(), "bucket", "left_semi").dropDuplicates(["blob_id"])

    def delete(self, ids: DataFrame) -> int:
        """Rewrite only the buckets that hold one of the ids; unknown ids do nothing. Returns how many rows went."""
        now = self.rows
        gone = now.join(ids.select("blob_id").distinct(), "blob_id", "left_semi")
        touched = [r.bucket for r in gone.select("bucket").distinct().collect()]
        if not touched:
            return 0
        count = gone.count()
        kept = now.where(F.col("bucket").isin(touched)).join(ids.select("blob_id").distinct(), "blob_id", "left_anti")
        folder = f"{self.path}-rewrite"
        kept.write.mode("overwrite").partitionBy("bucket").parquet(folder)  # a table can't be overwritten while it is read
        empty = set(touched) - {r.bucket for r in self.spark.read.schema(SCHEMA).parquet(folder).select("bucket").distinct().collect()} if count else set()
        self.spark.read.schema(SCHEMA).parquet(folder).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        store = hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in empty:
            store.delete(hadoop.Path(f"{self.path}/bucket={b}"), True)
        store.delete(hadoop.Path(folder), True)
        return count

    def list_buckets(self) -> DataFrame:
        return self.rows.select("bucket").distinct()

    def bucket_info(self) -> DataFrame:
        return self.rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.octet_length("ciphertext")).alias("bytes"))

    def stats(self) -> DataFrame:
        return self.bucket_info().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("buckets"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("n").alias("largest"))
