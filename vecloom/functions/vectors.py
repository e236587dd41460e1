"""Vector expressions that stay in the JVM. Elements are cast to double before arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def as_float(v: Column) -> Column:
    return v.cast("array<float>")


def _fold(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter of the two lengths."""
    return _fold(F.filter(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), lambda x: x.isNotNull()))


def l2sq(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(_fold(F.transform(as_double(v), lambda x: x * x)))


def normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    # The length is bound to a lambda variable, or it would be computed anew for each element.
    held = F.array(F.struct(as_double(v).alias("v"), norm(v).alias("n")))
    return F.flatten(F.transform(held, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(F.lit(0.0)))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if either is the zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two integer signatures."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hyperplane_signature(v: Column, planes: list[list[float]]) -> Column:
    """Bit i is set if the product with plane i is over zero (rounded to 9 places); at most 63 planes."""
    bits = [F.when(F.round(dot(v, F.array(*map(F.lit, p))), 9) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(planes)]
    out = F.lit(0).cast("long")
    for b in bits:
        out = out + b.cast("long")
    return out


def grid(score: Column, bits: int = 10) -> Column:
    """Score on a grid of 2**-bits, as a decoder of limited precision gives it."""
    return F.round(score * (1 << bits)) / (1 << bits)


def register_functions(spark: SparkSession) -> None:
    """The same as SQL functions of the session: vec_dot, vec_l2sq, vec_norm, vec_cosine, vec_hamming."""
    v = "ARRAY<DOUBLE>"
    fold = "aggregate({}, 0D, (s, x) -> s + x)"
    total = fold.format("zip_with(a, b, (x, y) -> x * y)")
    length = "sqrt(" + fold.format("transform({0}, x -> x * x)") + ")"
    bodies = {
        f"vec_dot(a {v}, b {v}) RETURNS DOUBLE": total,
        f"vec_l2sq(a {v}, b {v}) RETURNS DOUBLE": fold.format("zip_with(a, b, (x, y) -> (x - y) * (x - y))"),
        f"vec_norm(a {v}) RETURNS DOUBLE": length.format("a"),
        f"vec_cosine(a {v}, b {v}) RETURNS DOUBLE": f"coalesce(try_divide({total}, {length.format('a')} * {length.format('b')}), 0D)",
        "vec_hamming(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
