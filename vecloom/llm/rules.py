"""Quality rules in DataFrame functions only (operator 10, native).

Base figures come from the words and lines of each text. The verdict is a likelihood ratio: unigrams
and bigrams are hashed into BUCKETS, one multinomial is counted over a trusted target and one over the
raw corpus, and a document's mean log ratio is held against zero, less what chance alone explains at
its length. Every document gets the same deterministic test.

Defined results: a null or blank text has no words and fails the base; null ids are scored like any
row; with an empty target all ratios are zero and only base failures go; texts of any length are whole;
repeated rows are judged alike; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import words_of

BUCKETS = 8192
SYMBOLS = "[#*$%&|<>]"
SPAN = 8
#: Up to so many trusted ids are broadcast (a few dozen MB at most); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _pairs(a: Column, gap: int) -> Column:
    """Hash of each element with the one gap places on; empty when there is none."""
    n = F.size(a) - gap
    return F.when(n > 0, F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(a, 1 + gap, F.greatest(n, F.lit(0))), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


def base_figures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, the five base figures, base_failed, and the hashes h1 (words) and h2 (pairs)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep, text.alias("_t"), words_of(F.col("text")).alias("_w"), lines.alias("_l"))
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("h1"),
    )
    df = df.withColumn("h2", _pairs(F.col("h1"), 1))
    df = df.withColumn("_h4", _pairs(F.col("h2"), 2))
    df = df.withColumn("_h8", _pairs(F.col("_h4"), 4))
    # Only texts with some window found twice are sorted; equal windows are then neighbours.
    twice = F.size(F.array_distinct("_h8")) < F.size("_h8")
    at = F.when(twice, F.array_sort(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_s", at)
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    tail = F.slice("_s", 2, F.size("_s") - 1)
    head = F.slice("_s", 1, F.size("_s") - 1)
    df = df.withColumn("_z", F.when(F.col("_s").isNotNull(), F.arrays_zip(F.col("_s").alias("s"), F.concat(tail, none).alias("n"), F.concat(none, head).alias("p"))))
    same = F.filter("_z", lambda z: F.coalesce(z["s"]["h"] == z["n"]["h"], F.lit(False)) | F.coalesce(z["s"]["h"] == z["p"]["h"], F.lit(False)))
    df = df.withColumn("_p", F.array_sort(F.transform(same, lambda z: z["s"]["i"])))
    gaps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.least(F.lit(SPAN), F.coalesce(b - a, F.lit(SPAN))))
    covered = F.when(F.col("_p").isNotNull(), F.aggregate(gaps, F.lit(0), lambda s, g: s + g)).otherwise(0)
    df = df.withColumn("n_repeat_words", covered.cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "h1", "h2")


def _features(h1: Column, h2: Column) -> Column:
    return F.transform(F.concat(h1, h2), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def fit_ratio(docs: DataFrame, trusted: DataFrame) -> tuple[list[float], float]:
    """Log ratio of each bucket, and its standard deviation under the target; counts are over all documents.

    trusted holds the doc_id of target rows. Only 2 * BUCKETS counts reach the driver.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left")
    h = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    rows = rows.select(F.col("_id").isNotNull().alias("t"), h.alias("h1")).withColumn("h2", _pairs(F.col("h1"), 1))
    near = rows.select("t", F.explode(_features(F.col("h1"), F.col("h2"))).alias("b"))
    raw, target = [0.0] * BUCKETS, [0.0] * BUCKETS
    for r in near.groupBy("b", "t").count().collect():
        raw[r.b] += r["count"]
        if r.t:
            target[r.b] += r["count"]
    if not sum(target):
        return [0.0] * BUCKETS, 0.0
    total_t, total_r = sum(target) + BUCKETS, sum(raw) + BUCKETS
    pt = [(x + 1) / total_t for x in target]
    pr = [(x + 1) / total_r for x in raw]
    ratio = [round(math.log(a / b), 6) for a, b in zip(pt, pr, strict=True)]
    mean = sum(p * x for p, x in zip(pt, ratio, strict=True))
    return ratio, math.sqrt(sum(p * (x - mean) ** 2 for p, x in zip(pt, ratio, strict=True)))


def quality_rules(docs: DataFrame, trusted: DataFrame, z: float = 3.0) -> DataFrame:
    """doc_id, the base figures, base_failed, ratio (mean log ratio of a feature) and kept."""
    ratio, spread = fit_ratio(docs, trusted)
    df = base_figures(docs, ["doc_id"])
    weights = F.array(*map(F.lit, ratio))  # folded to one literal
    df = df.withColumn("_f", _features(F.col("h1"), F.col("h2")))
    total = F.aggregate("_f", F.lit(0.0), lambda s, b: s + F.get(weights, b))
    n = F.size("_f")
    df = df.withColumn("ratio", F.when(n > 0, total / n).otherwise(F.lit(0.0)))
    fine = F.round("ratio", 9) >= F.round(-z * F.lit(spread) / F.sqrt(F.greatest(n, F.lit(1))), 9)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", (~F.col("base_failed") & fine).alias("kept"))


def op10_rules(spark, sf_dir):
    from ._common import read_documents

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(read_documents(spark, sf_dir), labels.where("quality = 1"))
