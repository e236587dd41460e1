"""A stored signature index: add, remove, look up, search, statistics, save and load."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lsh


class LshIndex:
    """rows: vec_id, embedding, sig. Changes give a new DataFrame plan; save writes rows and planes."""

    def __init__(self, spark: SparkSession, planes: list[list[float]], rows: DataFrame | None = None):
        self.spark, self.planes = spark, planes
        self.rows = rows if rows is not None else spark.createDataFrame([], "vec_id string, embedding array<double>, sig long")

    @classmethod
    def create(cls, spark: SparkSession, dimension: int, bits: int = 16, seed: int | bytes = 42) -> LshIndex:
        return cls(spark, lsh.hyperplanes(bits, dimension, seed))

    def add(self, rows: DataFrame) -> None:
        """Rows of an id that is there already take its place."""
        plain = rows.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        new = plain.join(lsh.sign(plain, self.planes), "vec_id")
        self.rows = self.rows.join(new.select("vec_id"), "vec_id", "left_anti").unionByName(new)

    def remove(self, ids: DataFrame) -> None:
        self.rows = self.rows.join(ids.select(F.col("vec_id").cast("string").alias("vec_id")), "vec_id", "left_anti")

    def vectors(self, ids: DataFrame) -> DataFrame:
        return self.rows.join(ids.select(F.col("vec_id").cast("string").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "embedding")

    def search(self, queries: DataFrame, k: int, within: int | None = None) -> DataFrame:
        return lsh.hamming_candidates(lsh.sign(queries, self.planes, "query_id"), self.rows.select("vec_id", "sig"), k, within)

    def two_stage(self, queries: DataFrame, k: int = 10, first: int = 200) -> DataFrame:
        return lsh.two_stage(queries, self.rows, self.planes, k, first)

    def bucket_search(self, queries: DataFrame, k: int, flips: int = 0) -> DataFrame:
        """Exact scores within the query's own bucket and those one of the first `flips` bits away."""
        from .scan import rescore, top_k

        near = lsh.multi_probe(lsh.sign(queries, self.planes, "query_id"), self.rows.select("vec_id", "sig"), flips)
        return top_k(rescore(near, queries, self.rows), k)

    def stats(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("vectors"), F.countDistinct("sig").alias("buckets"))

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.spark.createDataFrame([(json.dumps(self.planes),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/planes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LshIndex:
        planes = json.loads(spark.read.text(f"{path}/planes").first().value)
        return cls(spark, planes, spark.read.parquet(f"{path}/rows"))
