"""States, refusals, versions and visibility of the database."""

import json

import pytest
from pyspark.sql import functions as F

from vecloom import errors
from vecloom.db import Config, VectorDB
from vecloom.sources.datasets import generate

KEY = bytes(32)


@pytest.fixture
def rows(spark):
    return generate(spark, 60, 8, seed=1).select("vec_id", "embedding")


def make(spark, tmp_path, **options):
    return VectorDB(spark, str(tmp_path / "db"), Config(8, **{"clusters": 4, "top_clusters": 4, "key": KEY} | options))


def ask(rows, n):
    return rows.where(F.col("vec_id").isin(*n)).select(F.col("vec_id").alias("query_id"), "embedding")


def test_states_and_refusals(spark, tmp_path, rows):
    db = make(spark, tmp_path)
    with pytest.raises(errors.NoVectors):
        db.build()
    with pytest.raises(errors.NoVectors):
        db.search(ask(rows, ["vec_1"]))
    with pytest.raises(errors.WrongDimension):
        db.add(generate(spark, 2, 5).select("vec_id", "embedding"))
    with pytest.raises(errors.EmptyId):
        db.add(rows.withColumn("vec_id", F.lit("")))
    assert db.state == "empty"
    db.add(rows)
    assert db.state == "buffered"
    with pytest.raises(errors.NotBuilt):
        db.search(ask(rows, ["vec_1"]))
    with pytest.raises(errors.NotFound):
        db.delete(spark.createDataFrame([("nobody",)], "vec_id string"))


def test_bad_configs():
    for bad in ({"clusters": 1}, {"probe_threshold": 2.0}, {"pca_dimension": 8}, {"pq_subspaces": 3}, {"padding": "odd"}, {"top_clusters": 9}, {"strategy": "none"}):
        with pytest.raises(errors.InvalidConfig):
            Config(8, **{"clusters": 4} | bad).checked()
    assert Config(8, clusters=64).checked().top_clusters == 4 and Config(8, clusters=3).checked().top_clusters == 3


def test_changes_are_visible(spark, tmp_path, rows):
    """Deletes hide at once, added rows are found at once under permuted buckets, the latest version wins, also after a rebuild."""
    db = make(spark, tmp_path, replicas=2, padding="bucketed", decoys=2)
    db.add(rows.withColumn("metadata", F.to_json(F.struct(F.lit("a").alias("kind"), (F.crc32("vec_id") % 3).alias("n")))))
    db.build()
    top = lambda q: {r.query_id: r.vec_id for r in db.search(q, 1).collect()}
    assert top(ask(rows, ["vec_1", "vec_2"])) == {"vec_1": "vec_1", "vec_2": "vec_2"}
    db.delete(spark.createDataFrame([("vec_1",)], "vec_id string"))
    assert top(ask(rows, ["vec_1"]))["vec_1"] != "vec_1" and not db.has("vec_1") and db.count() == 59
    fresh = generate(spark, 5, 8, seed=9).select(F.concat(F.lit("new_"), "vec_id").alias("vec_id"), "embedding")
    db.add(fresh)
    assert top(ask(fresh, ["new_vec_3"])) == {"new_vec_3": "new_vec_3"}
    moved = rows.where("vec_id = 'vec_7'").select(F.lit("vec_2").alias("vec_id"), "embedding")
    db.update(moved)
    assert {r.vec_id for r in db.search(ask(rows, ["vec_7"]), 2).collect()} == {"vec_2", "vec_7"}
    assert db.maintain() and not db.maintain()
    assert {r.vec_id for r in db.search(ask(rows, ["vec_7"]), 2).collect()} == {"vec_2", "vec_7"}
    assert not db.has("vec_1") and db.count() == 64 and db.stats()["blobs"] == 128
    assert db.metadata("vec_3")["kind"] == "a" and db.metadata("new_vec_1") is None
    n = db.metadata("vec_3")["n"]
    found = db.search_where(ask(rows, ["vec_3"]), {"n": n, "kind": "a"}, 5).collect()
    assert found[0].vec_id == "vec_3" and all(db.metadata(r.vec_id)["n"] == n for r in found)
    assert db.search_where(ask(rows, ["vec_3"]), {"none": 1}, 5).isEmpty()
    assert [r.vec_id for r in db.list(0, 2).collect()] == ["new_vec_0", "new_vec_1"]
    s = db.cluster_stats()
    assert s["clusters"] == 4 and abs(s["mean"] - 16) < 1e-9


def test_refused_changes_leave_rows_alone(spark, tmp_path, rows):
    db = make(spark, tmp_path)
    db.add(rows)
    with pytest.raises(errors.WrongDimension):
        db.update(generate(spark, 3, 5).select("vec_id", "embedding"))
    with pytest.raises(errors.NotFound):
        db.update(rows.limit(1).withColumn("vec_id", F.lit("nobody")))
    with pytest.raises(errors.RepeatedId):
        db.add(rows.limit(2).withColumn("vec_id", F.lit("twice")))
    assert db.count() == 60 and db.has("vec_1") and not db.has("twice")


def test_nothing_plain_on_disk(spark, tmp_path, rows):
    """No float of a vector and no word of the metadata is found in any file; padding is among the blobs and as long as they are."""
    db = make(spark, tmp_path, padding="bucketed", pq_subspaces=2)
    db.add(rows.withColumn("metadata", F.lit('{"secret": "zanzibar"}')))
    db.build()
    raw = b"".join(f.read_bytes() for f in (tmp_path / "db").rglob("*.parquet"))
    import numpy as np

    vectors = [np.asarray(r.embedding, "<f4").tobytes() for r in rows.collect()]
    assert b"zanzibar" not in raw and not any(v in raw or v[:12] in raw for v in vectors)
    sizes = {(r.a, r.b) for r in db.blobs.select(F.octet_length("ciphertext").alias("a"), F.octet_length("codes").alias("b")).distinct().collect()}
    counts = [r["count"] for r in db.blobs.groupBy("bucket").count().collect()]
    assert sizes == {(60, 32)} and all(n & (n - 1) == 0 for n in counts) and sum(counts) > 60 == db.stats()["blobs"]


def test_only_buckets_asked_for_are_read(spark, tmp_path, rows):
    """The plan prunes folders by bucket, does not decide about decoys before the fetch, and looks at changed ids only."""
    db = make(spark, tmp_path, top_clusters=1, decoys=1, strategy="strict")
    db.add(rows)
    db.build()
    q = ask(rows, ["vec_1"])
    r = {x.real: x for x in db.reads(q).collect()}
    assert r[True].buckets == r[False].buckets == 1 and r[False].blobs > 0
    plan = db.search(q, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN isnotnull(vec_id" in plan


def test_maintenance_thread(spark, tmp_path, rows):
    import time

    from vecloom.streaming.ingest import Maintenance

    db, seen = make(spark, tmp_path), []
    m = Maintenance(db, 0.2, seen.append).start()
    db.add(rows)
    for _ in range(300):
        if m.builds:
            break
        time.sleep(0.2)
    m.stop()
    assert m.builds >= 1 and db.state == "ready" and not seen


@pytest.mark.parametrize("options", [{"pca_dimension": 4}, {"pq_subspaces": 4}, {"strategy": "gap"}, {"epsilon": 1.0, "bernoulli": True}, {"score_bits": 10, "padding": "max"}])
def test_variants_find_themselves(spark, tmp_path, rows, options):
    db = make(spark, tmp_path, **options)
    db.add(rows)
    db.build()
    found = db.search(ask(rows, ["vec_5", "vec_9"]), 3).where("rank = 1").collect()
    assert {r.query_id: r.vec_id for r in found} == {"vec_5": "vec_5", "vec_9": "vec_9"}
    copy = str(tmp_path / "copy")
    db.save(copy)
    with pytest.raises(errors.AlreadyExists):
        db.save(copy)
    with pytest.raises(errors.InvalidConfig):
        VectorDB.load(spark, copy, bytes(range(32)))
    other = VectorDB.load(spark, copy, KEY)
    same = lambda d: sorted(map(tuple, d.search(ask(rows, ["vec_5"]), 5).collect()))
    assert same(db) == same(other)
    text = "".join(r.value for r in spark.read.text(f"{copy}/manifest").collect())
    assert "key" in json.loads(text) and KEY.hex() not in text


def test_rerank_window_follows_the_scored_rows(spark, tmp_path, monkeypatch):
    """The nearest of 3000 rows is at place 250 by codes: inside a tenth of the scored, outside 200."""
    from vecloom.operators import pq

    i = F.col("id").cast("double")
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") == 249, F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))).otherwise(F.array(F.sin(i) / 2, F.cos(i), F.sin(i * 2), F.lit(1.0))).alias("embedding"))
    db = VectorDB(spark, str(tmp_path), Config(4, clusters=2, top_clusters=2, strategy="strict", pq_subspaces=2))
    db.add(rows)
    db.build()
    monkeypatch.setattr(pq, "adc_scores", lambda tables, codes, pairs: pairs.withColumn("dist", F.col("vec_id").cast("double")))
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.vec_id for r in db.search(q, 1).collect()] == ["249"]
