"""A column computed batch by batch in Arrow, as a step of its own in the plan.

A Python function whose argument comes from a lambda expression is not taken out of a projection by the
optimizer; a step of its own can't be merged with what is below it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def with_column(rows: DataFrame, name: str, column: str, kind: T.DataType, fn: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """rows with fn(column) under name, which may be column itself."""
    fields = [f for f in rows.schema if f.name != name]
    schema = T.StructType([*fields, T.StructField(name, kind)])
    rows = rows.select(*(f.name for f in fields), column) if name == column else rows.select(*(f.name for f in fields))
    at = rows.columns.index(column)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(fields))), fn(b.column(at))], names=schema.names)

    return rows.mapInArrow(run, schema)
