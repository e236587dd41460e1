"""python -m vecloom [rows] [dimension]: generate vectors, build a database in a temporary folder, search, print results."""

from __future__ import annotations

import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .db import Config, VectorDB
from .sources.datasets import generate


def main(rows: int = 1000, dimension: int = 32) -> None:
    spark = SparkSession.builder.master("local[*]").appName("vecloom").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    data = generate(spark, rows, dimension).select("vec_id", "embedding")
    with tempfile.TemporaryDirectory() as folder:
        db = VectorDB(spark, f"{folder}/db", Config(dimension, clusters=16), progress=lambda phase, share: print(f"{phase}: {share:.0%}"))
        db.add(data)
        db.build()
        db.search(data.limit(3).select(F.col("vec_id").alias("query_id"), "embedding"), 5).orderBy("query_id", "rank").show(truncate=False)
        print(db.stats())
    spark.stop()


if __name__ == "__main__":
    main(*map(int, sys.argv[1:3]))
