"""Formulas, file formats and invariants of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import crypt, vectors
from vecloom.operators import cluster, filters, lsh, pq, privacy
from vecloom.operators.probe import threshold
from vecloom.operators.scan import exact_search
from vecloom.sources import datasets, vecfiles


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], 5, 6), ([0.0, 0.0], [1.0, 1.0], 0, 255)], "a array<double>, b array<double>, x long, y long")
    a, b = F.col("a"), F.col("b")
    got = df.select(vectors.dot(a, b), vectors.l2sq(a, b), vectors.norm(a), vectors.cosine(a, b), vectors.normalize(a), vectors.hamming(F.col("x"), F.col("y"))).collect()
    assert tuple(got[0]) == (24.0, 2.0, 5.0, 0.96, [0.6, 0.8], 2)
    assert tuple(got[1]) == (0.0, 2.0, 0.0, 0.0, [0.0, 0.0], 8)
    vectors.register_functions(spark)
    assert spark.sql("SELECT vec_dot(array(3D, 4D), array(4D, 3D)), vec_cosine(array(3D, 4D), array(4D, 3D)), vec_hamming(5L, 6L)").first()[:] == (24.0, 0.96, 2)


@pytest.mark.parametrize("kind,element", [("fvecs", float), ("ivecs", int), ("bvecs", int)])
def test_vector_files(spark, tmp_path, kind, element):
    want = [(i, [element(i + j) for j in range(5)]) for i in range(23)]
    rows = spark.createDataFrame(want, f"idx long, embedding array<{'float' if element is float else 'int'}>")
    assert vecfiles.write_vecs(rows, str(tmp_path / kind), kind) == 23
    back = vecfiles.read_vecs(spark, str(tmp_path / kind), kind).orderBy("idx").collect()
    assert [list(r.embedding) for r in back] == [v for _, v in want]


def test_broken_vector_files(spark, tmp_path):
    good = np.int32(2).tobytes() + np.array([1, 2], "<f4").tobytes()
    (tmp_path / "cut.fvecs").write_bytes(good + good[:7])
    (tmp_path / "odd.fvecs").write_bytes(good + np.int32(3).tobytes() + np.zeros(2, "<f4").tobytes())
    for name in ("cut", "odd"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            vecfiles.read_vecs(spark, str(tmp_path / f"{name}.fvecs")).collect()


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.txt").write_text("a 1 2\n\nb 3 4.5\n")
    assert [tuple(r) for r in datasets.glove(spark, str(tmp_path / "g.txt")).collect()] == [("a", [1.0, 2.0]), ("b", [3.0, 4.5])]
    (tmp_path / "bad.txt").write_text("a 1 2\nb 3\n")
    with pytest.raises(Exception, match="dimensions"):
        datasets.glove(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "b.json").write_text('[{"id": "x", "values": [1, 2], "metadata": {"k": "v"}}]')
    assert datasets.bootstrap(spark, str(tmp_path / "b.json")).first().embedding == [1.0, 2.0]
    a, b = (datasets.generate(spark.newSession() if n else spark, 20, 4).orderBy("idx").collect() for n in (0, 1))
    assert a == b and abs(sum(x * x for x in a[3].embedding) - 1) < 1e-9


def test_decoys(spark):
    assert [privacy.decoy_count(e, 128, 8) for e in (1, 2, 3, 100, 0)] == [45, 17, 6, 1, 0] and privacy.decoy_count(1, 8, 8) == 0
    clusters = spark.range(32).select(F.col("id").cast("int").alias("cluster_id"))
    probed = spark.range(40).select(F.col("id").alias("query_id"), (F.col("id") % 32).cast("int").alias("cluster_id"))
    exact = privacy.uniform_decoys(probed, clusters, 5)
    assert {r["count"] for r in exact.groupBy("query_id").count().collect()} == {5}
    assert exact.join(probed, ["query_id", "cluster_id"], "left_semi").isEmpty()
    loose = [r["count"] for r in privacy.bernoulli_decoys(probed, clusters, 5).groupBy("query_id").count().collect()]
    assert np.var(loose) >= 1
    pi = privacy.permutation(clusters).collect()
    assert sorted(r.bucket for r in pi) == list(range(32)) and any(r.bucket != r.cluster_id for r in pi)


def test_padding_never_decrypts(spark):
    counts = spark.createDataFrame([(0, 5), (1, 8), (2, 1)], "bucket int, n long")
    assert {r.bucket: r.target for r in privacy.padding_targets(counts).collect()} == {0: 8, 1: 8, 2: 1}
    pad = privacy.padding(counts, 4).collect()
    assert len(pad) == 3 and all(len(r.blob_id) == 64 and len(r.ciphertext) == crypt.blob_size(4) for r in pad)
    df = spark.createDataFrame([(r.blob_id, bytes(r.ciphertext)) for r in pad], "i string, c binary")
    assert df.where(crypt.decrypt(F.col("c"), bytes(32), F.col("i")).isNotNull()).isEmpty()


def test_keys():
    assert crypt.derive_key("a", b"s" * 16) == crypt.derive_key("a", b"s" * 16) != crypt.derive_key("b", b"s" * 16)
    assert len(crypt.fingerprint(crypt.new_key())) == 16


def test_probe_rules(spark):
    ranked = spark.createDataFrame([(0, c, s, c + 1) for c, s in enumerate([1.0, 0.9, 0.88, 0.5])] + [(1, c, s, c + 1) for c, s in enumerate([-0.5, -0.9, -0.92, -2.0])], "query_id int, cluster_id int, score double, r int")
    count = lambda df: {r.query_id: r["count"] for r in df.groupBy("query_id").count().collect()}
    assert count(threshold(ranked, 2, 4, 0.95)) == {0: 3, 1: 3}
    assert count(threshold(ranked, 2, 4, 1.0)) == {0: 2, 1: 2} == count(threshold(ranked, 2, 0, 0.5))


def test_filters(spark):
    df = spark.createDataFrame([("tech", 2024, True, 0.95)], "category string, year int, active boolean, score double").select(F.to_json(F.struct("*")).alias("m"))
    hit = lambda **w: df.where(filters.matches(F.col("m"), w)).count() == 1
    assert hit() and hit(category="tech") and hit(year=2024) and hit(year=2024.0) and hit(active=True) and hit(score=0.95) and hit(category="tech", year=2024)
    assert not (hit(category="art") or hit(year=2023) or hit(active=False) or hit(none=1) or hit(category="tech", year=1) or hit(year="x") or hit(category=1))
    none = spark.createDataFrame([(None,)], "m string")
    assert none.where(filters.matches(F.col("m"), {})).count() == 1 and none.where(filters.matches(F.col("m"), {"a": 1})).count() == 0


def test_kmeans_and_codes(spark):
    rng = np.random.default_rng(42)
    rows = spark.createDataFrame([(i, (2.0 * (i % 6) * np.eye(6)[i % 6] + rng.normal(0, 0.1, 6)).tolist()) for i in range(240)], "vec_id long, embedding array<double>")
    centroids, cost = cluster.fit_kmeans(rows, 6, inits=2, unit=False)
    near = cluster.assign(rows, centroids, 2)
    assert near.count() == 480 and cost > 0 and centroids.count() == 6
    book = pq.train(rows, 3, 16)
    err = pq.decode(pq.encode(rows, book), book).withColumnRenamed("embedding", "back").join(rows, "vec_id").agg(F.avg(vectors.l2sq(F.col("back"), F.col("embedding")))).first()[0]
    assert err < 0.2 and pq.rerank_count(10, 5000) == 500 and pq.rerank_count(10, 100) == 100
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert cluster.fit_kmeans(same, 2)[0].count() == 2


def test_hashes(spark):
    assert lsh.bits_for(64) == 8 and lsh.bits_for(2) == 6
    p = lsh.hyperplanes(16, 8, b"seed")
    assert p == lsh.hyperplanes(16, 8, b"seed") and all(math.isclose(np.linalg.norm(x), 1) for x in p)
    rows = datasets.generate(spark, 30, 8).select("vec_id", "embedding")
    q = rows.limit(1).select(F.lit(0).alias("query_id"), "embedding")
    assert lsh.two_stage(q, rows, p, 3).where("rank = 1 and score = 1.0").count() == 1
    assert lsh.bucket_centroids(rows, p, 4).agg(F.sum("n")).first()[0] == 30


def test_exact_search_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in exact_search(q, rows, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert exact_search(q.limit(0), rows, 3).count() == 0 and exact_search(q, rows.limit(0), 3).count() == 0
