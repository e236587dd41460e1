"""numpy kernels over the bytes of many documents at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _LIBC = None

U64 = np.uint64
#: Odd 64-bit multipliers for hashing.
BASE = 0x9E3779B97F4A7C15 | 1
K1, K2, K3 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0xD6E8FEB86659FD93)

IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 16)
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            a = np.full(n, U64(base))
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h *= K1
    h ^= h >> U64(33)
    h *= K2
    h ^= h >> U64(33)
    return h


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * K3 + b)


def to_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


def trim() -> None:
    """Give freed memory back to the system; Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def trimmed(fn):
    """fn for a group of rows or a pair of them, with its scratch memory given back after each group."""

    def one(table):
        out = fn(table)
        trim()
        return out

    def two(left, right):
        out = fn(left, right)
        trim()
        return out

    return one if fn.__code__.co_argcount == 1 else two


def chunks(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Slices of at most limit bytes, or of one text that is longer; keeps numpy's scratch space small.

    Scratch memory is given back after the last one; doing so after each would cost a quarter of the time.
    """
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
        trim()


class Words:
    """The words of some texts: start and end in buf, hash, and bounds[i]:bounds[i+1] for text i."""

    def __init__(self, texts: list[bytes], lower: bool = True, hashed: bool = True):
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.buf = LOWER[raw] if lower else raw
        white = IS_WHITE[raw]
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(self.start, offsets)
        if hashed:
            up, down = powers(len(raw))
            total = np.cumsum(self.buf.astype(U64) * up[: len(raw)])
            h = (total[self.end - 1] - total[self.start - 1]) * down[self.start]
            self.hash = mix(h + (self.end - self.start).astype(U64) * K3)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)
