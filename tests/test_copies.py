"""Searches over tables with copies, where ties decide, and searches of many queries at once."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.db import Config, VectorDB
from vecloom.operators import ivf
from vecloom.operators.scan import block_scan, exact_search, scorer
from vecloom.plans.queries import ORACLE_SQL, QUERIES
from vecloom.sources.datasets import generate


@pytest.fixture(scope="module")
def copied(spark, data, tmp_path_factory):
    """A folder with the embeddings table several times, under shifted ids."""

    def make(times: int) -> str:
        folder = tmp_path_factory.mktemp("copied")
        rows = spark.read.parquet(f"{data}/embeddings.parquet")
        step = rows.count()
        each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        each.select((F.col("vec_id") + F.col("i") * step).alias("vec_id"), "embedding", "label").coalesce(2).write.parquet(f"{folder}/embeddings.parquet")
        return str(folder)

    return {n: make(n) for n in (2, 6)}


def same(spark, folder, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    tidy = lambda found: sorted(tuple(round(float(x), 9) if isinstance(x, float) else str(x) for x in r) for r in found)
    assert tidy(df.select(*columns).collect()) == tidy(duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", ["database_where_pre", "database_where_post", "database_hidden_after", "update_then_search", "bucket_search", "two_level_search", "hybrid_search", "ivf_redundant_topk"])
def test_ties_go_to_the_smaller_number(spark, copied, name):
    """Ids are strings in a store, where "599" comes before "99"."""
    same(spark, copied[2], name)


def test_as_many_codes_are_reranked_as_the_sql_says(spark, copied):
    """Of over 2000 rows a tenth is more than 200."""
    same(spark, copied[6], "pq_rerank_topk")


def test_each_json_array_has_a_file(spark, copied):
    """Whatever partitions the arrays lie in, no file holds two."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        same(spark, copied[6], "json_bootstrap")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stored_vectors_give_exact_scores(spark, tmp_path):
    """Vectors in single precision, normalised before they are sealed, would give other scores in the sixth place."""
    rows = generate(spark, 400, 16, unit=False).select(F.col("idx").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    q = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    db = VectorDB(spark, str(tmp_path), Config(16, clusters=4, top_clusters=4))
    db.add(rows)
    db.build()
    got = {(r.query_id, int(r.vec_id), r.score, r["rank"]) for r in db.search(q, 50).collect()}
    assert got == {(r.query_id, r.vec_id, r.score, r["rank"]) for r in exact_search(q, rows, 50).collect()}


def test_rows_meet_queries_of_their_cluster_in_batches(spark):
    """Small batches, strings and copies in two clusters, against brute force."""
    rng = np.random.default_rng(3)
    v, q = rng.integers(-2, 3, (300, 4)).astype(float), rng.integers(-2, 3, (7, 4)).astype(float)
    name = [str(i * 7 % 300) if i % 5 else f"x{i % 50}-{i}" for i in range(300)]
    stored = spark.createDataFrame([(n, x.tolist(), c) for i, (n, x) in enumerate(zip(name, v, strict=True)) for c in {i % 6, i % 4}], "vec_id string, embedding array<double>, cluster_id int").repartition(2)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    probed = spark.createDataFrame([(i, c) for i in range(7) for c in (i % 3, 5 - i % 2)], "query_id long, cluster_id int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in block_scan(queries, stored, "embedding", scorer(), 9, "score", False, T.DoubleType(), probed, copies=2).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for j in range(7):
        s = np.round([float(x @ q[j]) / ((np.linalg.norm(x) * np.linalg.norm(q[j])) or np.inf) for x in v], 6) + 0.0
        mine = [(-s[i], not name[i].isdigit(), int(name[i]) if name[i].isdigit() else 0, name[i]) for i in range(300) if {i % 6, i % 4} & {j % 3, 5 - j % 2}]
        want += [(j, r + 1, n, -c + 0.0) for r, (c, _, _, n) in enumerate(sorted(mine)[:9])]
    assert got == sorted(want)


def test_no_row_for_each_pair_of_query_and_vector(spark):
    """Queries meet rows as matrices: the plan joins no queries, so its rows do not grow with their number times that of vectors."""
    rows = generate(spark, 50, 4).select(F.col("idx").alias("vec_id"), "embedding", (F.col("idx") % 3).cast("int").alias("cluster_id"))
    q = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    found = ivf.search(q, rows, q.select("query_id", F.lit(1).alias("cluster_id")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan and found.count() == 50 * 10


def test_a_database_scores_no_pairs_in_its_plan(spark, tmp_path):
    """Stored rows meet all queries after they are decrypted, not as a row for each pair with an expression for its score."""
    rows = generate(spark, 40, 4).select(F.col("idx").alias("vec_id"), "embedding", F.lit('{"a": 1}').alias("metadata"))
    db = VectorDB(spark, str(tmp_path), Config(4, clusters=2, top_clusters=2))
    db.add(rows)
    db.build()
    found = db.search_where(rows.select(F.col("vec_id").alias("query_id"), "embedding"), {"a": 1}, 3, before=True)
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 40 * 3
