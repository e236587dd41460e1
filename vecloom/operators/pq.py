"""Product quantization: codebooks by subspace, codes, distance tables and two-phase search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import as_double, l2sq
from .scan import rescore, top_k

#: A codebook is fitted on at most so many rows (those with the smallest hash of their id).
SAMPLE = 100_000
#: Queries whose distance tables are broadcast together (some 16 KB each).
TABLE_BLOCK = 2048


def train(rows: DataFrame, subspaces: int, codes: int = 256, seed: int = 73, max_iter: int = 25) -> DataFrame:
    """codebook: m, code, centroid. Each subspace is fitted on its own, on a bounded sample."""
    total = rows.count()
    if total > SAMPLE:
        draw = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30))
        rows = rows.where(draw < F.lit(int((1 << 30) * 1.2 * SAMPLE / total))).orderBy(draw, "vec_id").limit(SAMPLE)
    width = (rows.select(F.size("embedding")).first() or [0])[0] // subspaces
    parts = rows.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda m: F.slice(F.col("embedding"), m * width + 1, F.lit(width)))).alias("m", "x"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf.m.iloc[0])
        x = np.array(pdf.sort_values("vec_id").x.tolist(), np.float64)
        rng = np.random.default_rng(seed + m)
        k = min(codes, len(x))
        centres = [x[rng.integers(len(x))]]
        d = ((x - centres[0]) ** 2).sum(1)
        while len(centres) < k:
            centres.append(x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))])
            d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
        c, last = np.array(centres), np.inf
        for _ in range(max_iter):
            dist = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
            own = dist.argmin(1)
            cost = dist[np.arange(len(x)), own].sum()
            n = np.bincount(own, minlength=k)
            for j in range(x.shape[1]):
                s = np.bincount(own, x[:, j], k)
                c[:, j] = np.where(n > 0, s / np.maximum(n, 1), c[:, j])
            if abs(last - cost) <= 1e-6 * max(cost, 1e-12):
                break
            last = cost
        return pd.DataFrame({"m": m, "code": range(k), "centroid": list(c)})

    return parts.groupBy("m").applyInPandas(fit, "m int, code int, centroid array<double>")


def _book(codebook: DataFrame) -> DataFrame:
    """One row: arrays by subspace of arrays by code. Its size is codes times dimension, whatever the data."""
    by_m = codebook.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "centroid"))), lambda s: s["centroid"]).alias("cs"))
    return by_m.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "cs"))), lambda s: s["cs"]).alias("book"))


def _sub(v: Column, cs: Column, m: Column) -> Column:
    width = F.size(F.get(cs, F.lit(0)))
    return F.slice(as_double(v), m * width + 1, width)


def encode(rows: DataFrame, codebook: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, kept columns, codes: the nearest code of each subspace; ties to the smaller code. No shuffle of rows."""
    wide = rows.select("vec_id", *dict.fromkeys(("embedding", *keep))).join(F.broadcast(_book(codebook)))

    def nearest(cs, m):
        part = _sub(F.col("embedding"), cs, m)
        ranked = F.transform(cs, lambda c, j: F.struct(F.round(l2sq(part, c), 9).alias("d"), j.alias("code")))
        return F.array_min(ranked)["code"]

    return wide.select("vec_id", *keep, F.transform("book", nearest).alias("codes"))


def distance_tables(queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """query_id, adc: by subspace, the squared distance of the query's part to each code."""
    wide = queries.select("query_id", "embedding").join(F.broadcast(_book(codebook)))
    return wide.select("query_id", F.transform("book", lambda cs, m: F.transform(cs, lambda c: F.round(l2sq(_sub(F.col("embedding"), cs, m), c), 9))).alias("adc"))


def decode(encoded: DataFrame, codebook: DataFrame) -> DataFrame:
    """vec_id, embedding as the codes give it back."""
    wide = encoded.join(F.broadcast(_book(codebook)))
    return wide.select("vec_id", F.flatten(F.transform("codes", lambda c, m: F.get(F.get(F.col("book"), m), c))).alias("embedding"))


def adc_scores(tables: DataFrame, encoded: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """query_id, vec_id, dist from the tables, for all codes, or for candidate pairs only; codes that have their query_id already are not joined.

    Tables meet all codes TABLE_BLOCK queries at a time, which bounds what is broadcast.
    """
    total = F.aggregate(F.transform("codes", lambda c, m: F.get(F.get(F.col("adc"), m), c)), F.lit(0.0), lambda s, x: s + x)
    pick = lambda df: df.select("query_id", "vec_id", F.round(total, 6).alias("dist"))
    if "query_id" in encoded.columns:
        return pick(encoded.join(tables, "query_id"))
    if pairs is not None:
        return pick(pairs.join(encoded, "vec_id").join(tables, "query_id"))
    parts = max(1, -(-tables.count() // TABLE_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    scored = [pick(encoded.crossJoin(F.broadcast(tables.where(block == i)))) for i in range(parts)]
    return reduce(DataFrame.unionByName, scored)


def rerank_count(k: int, scored: int, multiplier: int = 20, floor: int = 200, share: float = 0.1) -> int:
    """Candidates that get exact scores: max(k * multiplier, floor, share of the scored), at most all of them."""
    return min(scored, max(k * multiplier, floor, int(scored * share)))


def shortlist(near: DataFrame, k: int, fixed: int | None = None) -> DataFrame:
    """The best candidates (query_id, vec_id, dist) of each query: a fixed number, or as many as rerank_count gives for what it scored."""
    if fixed is not None:
        return top_k(near, fixed, "dist", ascending=True)
    by = W.partitionBy("query_id")
    n = F.count("*").over(by)
    room = F.least(n, F.greatest(F.lit(k * 20), F.lit(200), (n / 10).cast("long")))
    return near.withColumn("room", room).withColumn("r", F.row_number().over(by.orderBy("dist", "vec_id"))).where(F.col("r") <= F.col("room"))


def two_phase(queries: DataFrame, rows: DataFrame, codebook: DataFrame, encoded: DataFrame, k: int = 10, pairs: DataFrame | None = None, fixed: int | None = None) -> DataFrame:
    """Approximate distances over codes, then exact scores for each query's best candidates (a fixed number of them, or as shortlist takes them)."""
    best = shortlist(adc_scores(distance_tables(queries, codebook), encoded, pairs), k, fixed)
    return top_k(rescore(best, queries, rows), k)
