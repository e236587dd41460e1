"""AES-GCM at rest with the row's id as authenticated data, and keys."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import with_column


@F.arrow_udf(T.BinaryType())
def vector_to_bytes(v: pa.Array) -> pa.Array:
    """Little-endian float32, four bytes an element."""
    return _packed(v, "<f4")


@F.arrow_udf(T.ArrayType(T.FloatType()))
def bytes_to_vector(b: pa.Array) -> pa.Array:
    return _unpacked(b, "<f4", pa.float32())


def with_bytes(rows: DataFrame, column: str, name: str, kind: str = "<f4") -> DataFrame:
    """rows and, under name, the bytes of a list column's elements (kind: <f4 for vectors, <u2 for codes)."""
    return with_column(rows, name, column, T.BinaryType(), lambda v: _packed(v, kind))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def bytes_to_codes(b: pa.Array) -> pa.Array:
    return _unpacked(b, "<u2", pa.int32())


def _packed(v: pa.Array, kind: str) -> pa.Array:
    """The elements of each list as bytes; whole batches at a time."""
    gone = np.asarray(v.is_null())
    begin = v.offsets.to_numpy().astype(np.int64)
    raw = v.values.to_numpy(zero_copy_only=False)[begin[0] : begin[-1]].astype(kind).tobytes()
    at = (begin - begin[0]) * np.dtype(kind).itemsize
    return pa.array([None if g else raw[a:b] for a, b, g in zip(at[:-1].tolist(), at[1:].tolist(), gone.tolist(), strict=True)], pa.binary())


def _unpacked(b: pa.Array, kind: str, element: pa.DataType) -> pa.Array:
    size = np.asarray(pa.compute.coalesce(pa.compute.binary_length(b), pa.scalar(0, pa.int32()))) // np.dtype(kind).itemsize
    raw = b"".join(x for x in b.to_pylist() if x)
    values = pa.array(np.frombuffer(raw, kind)).cast(element)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=b.is_null())


def new_key() -> bytes:
    return os.urandom(32)


def derive_key(password: str, salt: bytes) -> bytes:
    """256-bit key by a memory-hard function of the standard library."""
    return hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1, dklen=32)


def fingerprint(key: bytes) -> str:
    """First eight bytes of the key's SHA-256, in hex."""
    return hashlib.sha256(key).hexdigest()[:16]


def encrypt(data: Column, key: bytes, aad: Column) -> Column:
    """12-byte nonce, ciphertext, 16-byte tag. Nonces are random: write the result before using it twice."""
    return F.aes_encrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad.cast("string").cast("binary"))


def decrypt(data: Column, key: bytes, aad: Column) -> Column:
    """Null where the key or the id does not fit, or the payload was changed."""
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad.cast("string").cast("binary"))


def blob_size(dimension: int) -> int:
    """Bytes of an encrypted vector."""
    return 4 * dimension + 28


def random_codes(subspaces: int) -> Column:
    """Bytes as long as sealed codes, for rows that only pad (they have a blob_id)."""
    raw = F.unhex(F.concat(F.sha2(F.concat("blob_id", F.lit("a")), 512), F.sha2(F.concat("blob_id", F.lit("b")), 512)))
    return F.substring(F.concat(*[raw] * (1 + (2 * subspaces + 28) // 128)), 1, 2 * subspaces + 28)
