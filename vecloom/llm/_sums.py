"""Sums of fixed-length vectors over all partitions, without gathering partitions' vectors on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Vectors are cut into slices of so many numbers, so that their sums are spread over tasks.
SLICE = 8192


def partition_sum(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """fn turns a partition into one float64 vector (None: nothing); returns their sum, None if there is none.

    Partitions are added in their order, so that reruns give the same bits. The result is a few MB at most.
    """

    def emit(batches):
        v = fn(batches)
        if v is not None:
            part = TaskContext.get().partitionId()
            cuts = range(0, len(v), SLICE)
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([c // SLICE for c in cuts], pa.int32()), "wave": pa.array([part % 16] * len(cuts), pa.int32()),
                "part": pa.array([part] * len(cuts), pa.int32()), "v": pa.array([v[c : c + SLICE].tobytes() for c in cuts], pa.binary()),
            })

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["v"].to_pylist(), strict=True))
        total = np.sum([np.frombuffer(v, np.float64) for _, v in rows], axis=0)
        return pa.table({"slice": table["slice"][:1], "wave": table["wave"][:1], "v": pa.array([total.tobytes()], pa.binary())})

    rows = df.mapInArrow(emit, "slice int, wave int, part int, v binary").groupBy("slice", "wave").applyInArrow(add, "slice int, wave int, v binary").collect()
    if not rows:
        return None
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.slice, r.wave)):
        v = np.frombuffer(r.v, np.float64)
        out[r.slice] = out[r.slice] + v if r.slice in out else v
    return np.concatenate([out[k] for k in sorted(out)])
