"""Blob table, stored signature index, score providers and accounts."""

import pytest
from pyspark.sql import functions as F

from vecloom import errors
from vecloom.accounts import Accounts, Denied
from vecloom.operators.blobs import BlobTable
from vecloom.operators.cluster import fit_kmeans
from vecloom.operators.lsh_index import LshIndex
from vecloom.operators.provider import PlainProvider, agreement
from vecloom.sources.datasets import generate


def test_blob_table(spark, tmp_path):
    t = BlobTable(spark, str(tmp_path / "blobs"))
    assert t.rows.count() == 0 and t.stats().first().rows == 0
    t.put(spark.createDataFrame([(f"b{i}", i % 3, bytes([i]) * 4, 1) for i in range(9)], "blob_id string, bucket int, ciphertext binary, version int"))
    with pytest.raises(errors.AlreadyExists):
        t.put(spark.createDataFrame([("b1", 0, b"x", 1)], "blob_id string, bucket int, ciphertext binary, version int"))
    got = t.get(spark.createDataFrame([("b1",), ("none",)], "blob_id string")).orderBy("blob_id").collect()
    assert [(r.blob_id, r.bucket) for r in got] == [("b1", 1), ("none", None)]
    assert t.bucket(0, 1).count() == 6 == t.buckets_of(spark.createDataFrame([(0,), (1,), (1,)], "bucket int")).count()
    assert t.delete(spark.createDataFrame([("b0",), ("b3",), ("b6",), ("b1",), ("none",)], "blob_id string")) == 4
    assert sorted(r.blob_id for r in t.rows.collect()) == ["b2", "b4", "b5", "b7", "b8"]
    assert t.delete(spark.createDataFrame([("b0",)], "blob_id string")) == 0
    assert {r.bucket: (r.n, r.bytes) for r in t.bucket_info().collect()} == {1: (2, 8), 2: (3, 12)} and t.list_buckets().count() == 2
    assert tuple(t.stats().first()) == (5, 2, 20, 3)


def test_signature_index(spark, tmp_path):
    rows = generate(spark, 40, 8).select("vec_id", "embedding")
    q = rows.where("vec_id = 'vec_4'").select(F.lit(1).alias("query_id"), "embedding")
    x = LshIndex.create(spark, 8, 12)
    x.add(rows)
    x.add(rows.limit(3))
    assert x.stats().first().vectors == 40
    assert x.search(q, 3).where("rank = 1").first().hamming == 0 and x.two_stage(q, 1).first().vec_id == "vec_4"
    assert x.bucket_search(q, 1, 4).first().vec_id == "vec_4" and x.search(q, 50, within=0).where("hamming > 0").isEmpty()
    x.save(str(tmp_path / "x"))
    y = LshIndex.load(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, y.search(q, 5).collect())) == sorted(map(tuple, x.search(q, 5).collect()))
    y.remove(rows.where("vec_id = 'vec_4'").select("vec_id"))
    assert y.stats().first().vectors == 39 and y.vectors(rows.where("vec_id in ('vec_4', 'vec_5')")).count() == 1


def test_providers_agree(spark):
    rows = generate(spark, 80, 8).select("vec_id", "embedding")
    centroids, _ = fit_kmeans(rows, 8)
    q = rows.limit(10).select(F.col("vec_id").alias("query_id"), "embedding")
    a, b = PlainProvider().scores(q, centroids), PlainProvider(10).scores(q, centroids)
    assert agreement(a, b, 3).where("same < 0.6").isEmpty() and b.where("score * 1024 <> round(score * 1024)").isEmpty()


def test_accounts():
    now = [0.0]
    a = Accounts(ttl=100, window=10, clock=lambda: now[0])
    a.register("ann", "secret", "t1")
    a.register("root", "pw", "t2", {"admin"})
    with pytest.raises(errors.AlreadyExists):
        a.register("ann", "x", "t1")
    with pytest.raises(Denied):
        a.login("ann", "wrong")
    t = a.login("ann", "secret")
    assert a.check(t.value, "search", "t1") is t and a.refresh(t.value) is t
    for bad in ({"scope": "write"}, {"tenant": "t2"}):
        with pytest.raises(Denied):
            a.check(t.value, **bad)
    assert a.login("root", "pw").has_scope("anything") and a.active == 2
    now[0] = 95
    u = a.refresh(t.value)
    assert u.value != t.value and a.check(u.value)
    now[0] = 101
    assert a.cleanup() == 1 and a.active == 1
    a.enable("ann", False)
    with pytest.raises(Denied):
        a.check(u.value)
    with pytest.raises(Denied):
        a.login("ann", "secret")


def test_query_log(spark):
    from vecloom.operators.query_log import privacy_metrics, with_dummies

    q = generate(spark, 200, 6).select(F.col("vec_id").alias("query_id"), "embedding")
    mixed = with_dummies(q, 6, 0.5)
    real, dummies = mixed.where("real").count(), mixed.where("not real").count()
    assert real == 200 and 60 < dummies < 140 and mixed.where("size(embedding) <> 6").isEmpty()
    log = spark.createDataFrame([(True, 4, 4, 10.0), (False, 4, 8, 20.0)], "real boolean, probed int, decoys int, ms double")
    assert tuple(privacy_metrics(log).first()) == (1, 1, 8, 12, 0.6, 15.0)
    assert tuple(privacy_metrics(log.limit(0)).first())[:2] == (0, 0)


def test_unhurried_answers():
    from vecloom.operators.query_log import unhurried

    waits = []
    assert unhurried(lambda x: x + 1, 5.0, 2.0, draw=lambda: 0.5, sleep=waits.append)(1) == 2
    assert 5.9 < waits[0] <= 6.0


def test_numbers_without_gaps(spark, tmp_path):
    from vecloom.sources.datasets import numbered

    rows = spark.range(100).repartition(7).select("id")
    assert sorted(r.idx for r in numbered(rows).collect()) == list(range(100)) and numbered(rows.limit(0)).count() == 0


def test_tenant_needs_its_key(spark, tmp_path):
    from vecloom.tenants import Tenant

    Tenant("t", 8).save(spark, str(tmp_path / "t"), bytes(32))
    with pytest.raises(errors.InvalidConfig):
        Tenant.load(spark, str(tmp_path / "t"), b"x" * 32)
