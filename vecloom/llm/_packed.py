"""Columnar exchange: hashes travel between groups of documents and hash ranges in packed arrays.

Groups of documents and ranges of hashes are both many, so that each fits a worker; a row of the
exchange holds all that one group says to one range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import U64

LOW40 = U64((1 << 40) - 1)


PACKED = "g int, n int, body binary"


def pack_rows(g: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
    """g, n and body: the rows of each group in one compressed Arrow stream; halves what a shuffle of texts writes."""
    order = np.argsort(g, kind="stable")
    head = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1])) if len(g) else np.zeros(0, np.int64)
    out = []
    for at in np.split(order, head[1:]) if len(head) else []:
        part = rows.take(pa.array(at))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(part)
        out.append((int(g[at[0]]), len(at), sink.getvalue().to_pybytes()))
    c = list(zip(*out, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary())], names=["g", "n", "body"])


def pack_texts(docs: DataFrame, groups: int, carry: list[str]) -> DataFrame:
    """The packed rows (carry columns and text) of each group."""
    from ._common import grouping

    def run(batches):
        for b in batches:
            yield pack_rows(b.column(0).to_numpy(), b.select(list(range(1, b.num_columns))))

    return docs.select(grouping(groups).alias("g"), *carry, "text").mapInArrow(run, PACKED)


def unpack_texts(table: pa.Table) -> pa.Table:
    """The rows of a group, in the order of their packed parts' bytes, which is the same at every run."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in sorted(table["body"].to_pylist())])


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash; ascending with the hash."""
    return ((h >> U64(32)) * np.full(1, ranges, U64) >> U64(32)).astype(np.int64)


def squeeze(raw: bytes) -> bytes:
    """Size and compressed bytes."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueeze(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, most of them small, compressed."""
    return pa.compress(counts.astype("<u8").tobytes(), "zstd", asbytes=True)


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), "<u8")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], np.add.reduceat(counts, head)
