"""Principal components: centred fit, projection, inverse and reconstruction error."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import with_column
from ..functions.vectors import l2sq

DOUBLES = T.ArrayType(T.DoubleType())


def _affine(x: pa.Array, matrix: np.ndarray, shift: np.ndarray) -> pa.Array:
    """Each list times matrix plus shift, one product a batch."""
    gone = x.is_null()
    keep = np.flatnonzero(~np.asarray(gone))
    out = np.zeros((len(x), matrix.shape[1]))
    if len(keep):
        out[keep] = x.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).reshape(len(keep), -1).astype(np.float64) @ matrix + shift
    offsets = pa.array(np.arange(len(x) + 1) * matrix.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=gone)


class Components:
    """mean, components (one list a component) and the share of variance of each."""

    def __init__(self, mean: list[float], components: list[list[float]], variance: list[float]):
        self.mean, self.components, self.variance = mean, components, variance

    def project(self, rows: DataFrame, column: str = "embedding", name: str = "embedding") -> DataFrame:
        """rows with the centred products of a column with all components. The matrix travels with the task and is no part of the plan."""
        m = np.array(self.components).T
        shift = -np.array(self.mean) @ m
        return with_column(rows, name, column, DOUBLES, lambda x: _affine(x, m, shift))

    def restore(self, rows: DataFrame, column: str = "embedding", name: str = "embedding") -> DataFrame:
        m, shift = np.array(self.components), np.array(self.mean)
        return with_column(rows, name, column, DOUBLES, lambda x: _affine(x, m, shift))

    def reconstruction_error(self, rows: DataFrame) -> DataFrame:
        """mse: mean squared error of an element after projection and back."""
        back = self.restore(self.project(rows.select("embedding"), name="p"), "p", "back")
        return back.agg(F.avg(l2sq(F.col("embedding"), F.col("back")) / F.size("embedding")).alias("mse"))


def fit(rows: DataFrame, k: int) -> Components:
    data = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="out").fit(data)
    width = rows.select(F.size("embedding")).first()[0]
    means = rows.select(*(F.avg(F.get("embedding", F.lit(i))).alias(str(i)) for i in range(width))).first()
    pc = model.pc.toArray()
    return Components([float(x) for x in means], [[float(x) for x in pc[:, j]] for j in range(k)], [float(x) for x in model.explainedVariance])
