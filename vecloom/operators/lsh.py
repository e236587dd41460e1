"""Random-hyperplane signatures, Hamming search, multi-probe and two-stage search."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import hyperplane_signature
from .cluster import mean_vectors
from .scan import block_scan, rescore, top_k


def hyperplanes(bits: int, dimension: int, seed: int | bytes = 42) -> list[list[float]]:
    """Unit Gaussian normals from an integer or from seed bytes."""
    rng = np.random.default_rng(list(seed) if isinstance(seed, bytes) else seed)
    p = rng.standard_normal((bits, dimension))
    return (p / np.linalg.norm(p, axis=1, keepdims=True)).tolist()


def bits_for(buckets: int) -> int:
    return max(6, math.ceil(math.log2(max(2, buckets))) + 2)


def sign(rows: DataFrame, planes: list[list[float]], id_column: str = "vec_id") -> DataFrame:
    return rows.select(id_column, hyperplane_signature(F.col("embedding"), planes).alias("sig"))


def sign_wide(rows: DataFrame, planes: list[list[float]], id_column: str = "vec_id", bits: int = 32) -> DataFrame:
    """Signatures of any width: `words`, an array of longs with `bits` planes each, least significant bit first."""
    parts = [hyperplane_signature(F.col("embedding"), planes[i : i + bits]) for i in range(0, len(planes), bits)]
    return rows.select(id_column, F.array(*parts).alias("words"))


def hamming_wide(queries: DataFrame, signed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, hamming, rank over word arrays (sign_wide); queries in blocks."""

    def distance(words: list, q: np.ndarray) -> np.ndarray:
        w = np.ascontiguousarray(words, np.int64).view(np.uint64)
        return sum(np.bitwise_count(w[:, None, i] ^ q.astype(np.int64).view(np.uint64)[None, :, i]).astype(np.float64) for i in range(w.shape[1]))

    return block_scan(queries, signed, "words", distance, k, "hamming", True, T.IntegerType())


def bucket(sig: Column, buckets: int) -> Column:
    return F.pmod(sig, F.lit(buckets)).cast("int")


def mask(sig: Column, key: int) -> Column:
    """Signature under a session key; Hamming distances between equally masked signatures stay."""
    return sig.bitwiseXOR(F.lit(key))


def hamming_candidates(queries: DataFrame, signed: DataFrame, k: int, within: int | None = None) -> DataFrame:
    """query_id, vec_id, hamming, rank: the k nearest signatures (sig), optionally within a distance; queries in blocks."""

    def distance(sigs: list, q: np.ndarray) -> np.ndarray:
        return np.bitwise_count(np.array(sigs, np.int64)[:, None].view(np.uint64) ^ q.astype(np.int64).view(np.uint64)).astype(np.float64)

    found = block_scan(queries, signed, "sig", distance, k, "hamming", True, T.IntegerType())
    return found if within is None else found.where(F.col("hamming") <= within)


def multi_probe(queries: DataFrame, signed: DataFrame, flips: int) -> DataFrame:
    """query_id, vec_id: rows in the query's own bucket and in those with one of the first `flips` bits flipped."""
    own = F.array("sig")
    more = F.transform(F.sequence(F.lit(0), F.lit(flips - 1)), lambda i: F.col("sig").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))) if flips > 0 else F.array().cast("array<bigint>")
    wanted = queries.select("query_id", F.explode(F.concat(own, more)).alias("sig"))
    return wanted.join(signed.select("vec_id", "sig"), "sig").select("query_id", "vec_id").distinct()


def neighbour_buckets(bucket_id: Column, count: int, buckets: int) -> Column:
    """bucket_id and the count - 1 after it, around the end."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.pmod(bucket_id + i, F.lit(buckets)))


def two_stage(queries: DataFrame, rows: DataFrame, planes: list[list[float]], k: int = 10, first: int = 200) -> DataFrame:
    """The `first` nearest signatures of each query, then exact cosine among them."""
    near = hamming_candidates(sign(queries, planes, "query_id"), sign(rows, planes), first)
    return top_k(rescore(near, queries, rows), k)


def bucket_centroids(rows: DataFrame, planes: list[list[float]], buckets: int) -> DataFrame:
    """bucket, n, centroid: unit mean of each bucket's vectors."""
    from ..functions.vectors import normalize

    dealt = rows.select("embedding", bucket(hyperplane_signature(F.col("embedding"), planes), buckets).alias("bucket"))
    return mean_vectors(dealt, "bucket").select("bucket", normalize(F.col("centroid")).alias("centroid")).join(dealt.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
