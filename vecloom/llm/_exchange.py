"""Exchange between groups of documents and ranges of hashes, with rows in proportion to the groups.

A group sends one row to each of FAN ranges, whatever the input, and gets one back from each. Up to FAN
groups a range can take them all. Beyond that the rows of FAN groups for one range meet in a bundle, which
merges them and is a group of the next round: it sends one row to each of FAN parts of its range. So every
round has FAN rows a group, tasks hold the same share at any size, and rounds grow with the logarithm of the
number of groups. A key that all groups have is merged in a tree on its way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed
from ._packed import pack_counts, squeeze, summed, unpack_counts, unsqueeze
from ._text import U64, trimmed

#: Ranges that a group sends to, and groups that a range hears; a power of two.
FAN = 256
#: Keys are the upper bits of a hash; two keys are equal by chance as often as such bits are.
BITS = 48

SAID = "k int, q long, g int, keys binary, vals binary"
BACK = "k int, q long, g int, n int, back binary"


def bits_of(fan: int) -> int:
    return fan.bit_length() - 1


def digit(keys: np.ndarray, level: int, fan: int) -> np.ndarray:
    """Part of its range at `level` (1: the first) that a key of BITS bits goes to; ascending with the key within a range."""
    b = bits_of(fan)
    return (keys >> U64(BITS - b * level) & U64(fan - 1)).astype(np.int64)


def narrowed(h: np.ndarray) -> np.ndarray:
    return h >> U64(64 - BITS)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as byte planes of their differences."""
    d = np.diff(keys, prepend=U64(0))
    first, d = int(d[0]) if len(d) else 0, d[1:]
    wide = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return len(keys).to_bytes(4, "little") + first.to_bytes(8, "little") + squeeze(planes.tobytes())


def unpack_keys(raw: bytes) -> np.ndarray:
    n, first = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:12], "little")
    if not n:
        return np.zeros(0, U64)
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(unsqueeze(raw[12:]), np.uint8)
    if n > 1:
        out[1:, : len(planes) // (n - 1)] = planes.reshape(-1, n - 1).T
    d = out.view("<u8").ravel().astype(U64)
    d[0] = first
    return np.cumsum(d, dtype=U64)


def table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def cut(keys: np.ndarray, level: int, fan: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of ascending keys of one range."""
    at = np.searchsorted(digit(keys, level, fan), np.arange(fan + 1))
    return [(r, a, b) for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if b > a]


def say(k: int, g: int, q: int, keys: np.ndarray, vals: np.ndarray, level: int, fan: int) -> list[tuple]:
    """Rows of SAID for ascending distinct keys of one range q (0 at the first level)."""
    return [(k, q * fan + r, g, pack_keys(keys[a:b]), pack_counts(vals[a:b])) for r, a, b in cut(keys, level, fan)]


def _read(t: pa.Table) -> dict[int, list]:
    """By kind: (q, g, keys, vals) of each row, in order of q and g."""
    out: dict[int, list] = {}
    for k, q, g, keys, vals in sorted(zip(*(t[c].to_pylist() for c in ("k", "q", "g", "keys", "vals")), strict=True)):
        keys = unpack_keys(keys)
        out.setdefault(k, []).append((q, g, keys, unpack_counts(vals, len(keys))))
    return out


def _merged(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]))


def exchange(said: DataFrame, groups: int, answer: Callable[[int, np.ndarray, np.ndarray], np.ndarray], totals: bool = False, fan: int = FAN, level: int = 1) -> DataFrame:
    """k, q, g, n, back: for each row said, answer(kind, keys, sums) of its n keys; with totals, rows of g = -1 with the sum and number of kind 0's sums.

    said has the rows of say() at `level`; vals are summed over groups.
    """
    if groups <= fan:

        def decide(t: pa.Table) -> pa.Table:
            out = []
            for k, rows in _read(t).items():
                keys, sums = _merged(rows)
                found = answer(k, keys, sums)
                out += [(k, q, g, len(own), pack_counts(found[np.searchsorted(keys, own)])) for q, g, own, _ in rows]
                if totals and k == 0:
                    out.append((0, rows[0][0], -1, 0, np.array([sums.sum(), (sums > 0).sum()], np.int64).tobytes()))
            return table(out, BACK)

        return said.groupBy("q").applyInArrow(trimmed(decide), BACK)

    said = checkpointed(said, release=True).withColumn("b", F.floor(F.col("g") / fan).cast("int"))

    def bundle(t: pa.Table) -> pa.Table:
        q, b = t["q"][0].as_py(), t["b"][0].as_py()
        return table([x for k, rows in _read(t).items() for x in say(k, b, q, *_merged(rows), level + 1, fan)], SAID)

    found = checkpointed(exchange(said.groupBy("q", "b").applyInArrow(trimmed(bundle), SAID), -(-groups // fan), answer, totals, fan, level + 1), release=True)

    def unbundle(left: pa.Table, right: pa.Table) -> pa.Table:
        out, back = [], {}
        for k, q, n, x in sorted(zip(*(right[c].to_pylist() for c in ("k", "q", "n", "back")), strict=True)):
            back.setdefault(k, []).append(unpack_counts(x, n))
        for k, rows in (_read(left) if left.num_rows else {}).items():
            keys, _ = _merged(rows)
            given = np.concatenate(back[k])
            out += [(k, q, g, len(own), pack_counts(given[np.searchsorted(keys, own)])) for q, g, own, _ in rows]
        return table(out, BACK)

    down = found.where("g >= 0").select("k", "n", "back", "q", F.floor(F.col("q") / fan).alias("up"), F.col("g").alias("b"))
    out = said.groupBy("q", "b").cogroup(down.groupBy("up", "b")).applyInArrow(trimmed(unbundle), BACK)
    return out.unionByName(found.where("g < 0")) if totals else out


def heard(t: pa.Table, k: int) -> np.ndarray:
    """What a group hears about its keys of a kind, in their order."""
    rows = sorted((q, n, x) for kk, q, n, x in zip(*(t[c].to_pylist() for c in ("k", "q", "n", "back")), strict=True) if kk == k)
    return np.concatenate([unpack_counts(x, n) for _, n, x in rows]) if rows else np.zeros(0, U64)
