"""Metadata filters, tombstones, versions and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scan import top_k


def matches(metadata: Column, where: dict) -> Column:
    """AND of equalities over a JSON string column; numbers compare as doubles; a missing key never matches."""

    def one(key: str, value) -> Column:
        got = F.try_variant_get(F.try_parse_json(metadata), "$." + key, "string")
        if isinstance(value, bool):
            return got == F.lit(str(value).lower())
        if isinstance(value, (int, float)):
            kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(metadata), "$." + key, "variant"))
            number = F.try_variant_get(F.try_parse_json(metadata), "$." + key, "double")
            return (number == F.lit(float(value))) & ~kind.isin("STRING", "BOOLEAN")
        return got == F.lit(value)

    parts = [F.coalesce(one(k, v), F.lit(False)) for k, v in where.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filtered_after(found: DataFrame, metadata: DataFrame, where: dict, k: int) -> DataFrame:
    """The first max(3k, 50) results, then those whose metadata match, then k of them; may be fewer than k."""
    wide = found.where(F.col("rank") <= max(3 * k, 50)).join(metadata, "vec_id", "left").where(matches(F.col("metadata"), where))
    return top_k(wide.select("query_id", "vec_id", "score"), k)


def live(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Latest version of each vec_id that no tombstone of the same or a later version covers."""
    newest = latest(rows)
    dead = tombstones.groupBy("vec_id").agg(F.max("version").alias("dead"))
    return newest.join(dead, "vec_id", "left").where(F.col("dead").isNull() | (F.col("dead") < F.col("version"))).drop("dead")


def latest(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("vec_id").orderBy(F.desc("version"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def newest(rows: DataFrame, order: str) -> DataFrame:
    """One row of each vec_id: the one with the largest `order`, and of equal ones the one with the largest vector."""
    by = W.partitionBy("vec_id").orderBy(F.desc(order), F.desc("embedding"))
    return rows.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """vec_id in order, from offset on."""
    return rows.select("vec_id").orderBy("vec_id").offset(offset).limit(limit)
