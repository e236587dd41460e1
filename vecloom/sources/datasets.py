"""Text vectors, bootstrap JSON, dataset bundles and generators."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalize
from .vecfiles import ground_truth, read_vecs

#: Names under which Parquet datasets hold their vectors.
VECTOR_COLUMNS = ("openai", "embedding", "embeddings", "vector", "values")


@dataclass
class Dataset:
    """base (vec_id, idx, embedding), queries and ground truth, where there are any."""

    name: str
    base: DataFrame
    queries: DataFrame | None = None
    truth: DataFrame | None = None

    def subset(self, n: int) -> Dataset:
        return Dataset(self.name, self.base.where(F.col("idx") < n), self.queries, None)

    def stats(self) -> DataFrame:
        return self.base.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimension"))


def _named(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.concat(F.lit(name + "_"), F.col("idx").cast("string")).alias("vec_id"), "idx", "embedding")


def from_files(spark: SparkSession, name: str, base: str, queries: str | None = None, truth: str | None = None) -> Dataset:
    """Bundle of vector files; their kinds follow from their extensions."""
    kind = lambda p: p.rstrip("/*").rpartition(".")[2]
    return Dataset(name, _named(read_vecs(spark, base, kind(base)), name), read_vecs(spark, queries, kind(queries)) if queries else None, ground_truth(spark, truth) if truth else None)


def from_parquet(spark: SparkSession, name: str, path: str) -> Dataset:
    rows = spark.read.parquet(path)
    column = next((c for c in VECTOR_COLUMNS if c in rows.columns), None)
    if column is None:
        raise ValueError(f"no vector column among {rows.columns}")
    return Dataset(name, _named(numbered(rows.select(F.col(column).alias("embedding"))), name))


def numbered(rows: DataFrame) -> DataFrame:
    """idx (0, 1, 2, ... without gaps, in the order of files and rows) and the columns of rows.

    One more pass counts the rows of each split; only one number a split reaches the driver.
    """
    place = rows.withColumn("_at", F.monotonically_increasing_id())
    split = F.shiftright("_at", 33).cast("int")
    sizes = place.select(split.alias("s")).groupBy("s").count().orderBy("s").collect()
    before, begin = 0, [0] * (max((r.s for r in sizes), default=-1) + 1)
    for r in sizes:
        begin[r.s], before = before, before + r["count"]
    starts = F.array(*(F.lit(b).cast("long") for b in begin)) if begin else F.array(F.lit(0).cast("long"))
    return place.select((F.get(starts, split) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("idx"), *rows.columns)


def glove(spark: SparkSession, path: str) -> DataFrame:
    """word and embedding of each line `word v1 ... vn`; blank lines are skipped, another dimension is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"))
    first = lines.select(F.size("p")).first()
    dim = first[0] - 1 if first else 0
    values = F.slice("p", F.lit(2), F.size("p") - 1).cast("array<double>")
    checked = F.when(F.size("p") == dim + 1, values).otherwise(F.raise_error(F.lit("dimensions differ")).cast("array<double>"))
    return lines.select(F.get("p", F.lit(0)).alias("word"), checked.alias("embedding"))


def bootstrap(spark: SparkSession, path: str) -> DataFrame:
    """vec_id, embedding, metadata (JSON) of an array of {id, values, metadata}."""
    rows = spark.read.schema("id string, values array<double>, metadata map<string,string>").json(path, multiLine=True)
    return rows.select(F.col("id").alias("vec_id"), F.col("values").alias("embedding"), F.to_json("metadata").alias("metadata"))


def uniform(n: Column, j: Column, seed: int) -> Column:
    """Number in [-1, 1) from a hash of row, place and seed."""
    return F.pmod(F.xxhash64(n, j, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 39)) - 1.0


def generate(spark: SparkSession, n: int, dimension: int, seed: int = 42, unit: bool = True) -> DataFrame:
    """vec_id, idx, embedding: seeded vectors, the same for any partitioning."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda j: uniform(F.col("id"), j, seed))
    return spark.range(n).select(F.concat(F.lit("vec_"), F.col("id").cast("string")).alias("vec_id"), F.col("id").alias("idx"), (normalize(raw) if unit else raw).alias("embedding"))


def hashed_text(text: Column, dimension: int = 64) -> Column:
    """Unit vector of signed word hashes of the whole text: an encoder that needs no model. Blank texts give zeros."""

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        def one(t):
            h = np.array([zlib.crc32(w.encode()) for w in re.findall(r"\w+", (t or "").lower())], np.int64)
            v = np.bincount(h % dimension, np.where(h >> 20 & 1, 1.0, -1.0), dimension)
            return v / (np.linalg.norm(v) or 1.0)

        return texts.map(one)

    return encode(text)
