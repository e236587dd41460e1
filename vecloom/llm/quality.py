"""Quality scores from random Fourier features of document statistics (operator 3).

Statistics of the whole text are standardised; random Fourier features approximate a Gaussian kernel
over them; each partition sums its part of the normal equations, whose ridge solution scores a text;
isotonic regression on a fine histogram of training scores turns scores into probabilities. Sums and
histograms cover all labelled rows, and what reaches the driver has a fixed size.

Defined results: a null text counts as empty and is scored like any text; rows without a label or with
a null label are scored but not learned from; repeated labels count once each; without labels every
score is 0.5, with labels of one kind it is that kind; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, crc_mod, read_documents
from ._sums import partition_sum
from ._text import Words, chunks, pair_hash, to_bytes

DIM = 320
BINS = 2048
LOW, HIGH = -0.5, 1.5
#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 stop, 5 comma and the like, 6 symbol, 7 exclamation, 8 newline, 9 space, 10 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, b".?"), (5, b",;:'\"()-"), (6, b"#*$%&|<>@{}[]=+~^_\\/"), (7, b"!"), (8, b"\n"), (9, b" \t\r\x0b\x0c"), (10, range(128, 256))):
    _CLASS[list(_chars)] = _k
N_CLASS = 11
N_STATS = N_CLASS + 13


def statistics(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), N_STATS), np.float32)
    for lo, hi in chunks(texts, 1 << 20):
        part = texts[lo:hi]
        w = Words(part, lower=False)
        length = w.end - w.start
        kinds = _CLASS[w.buf]
        first, last = kinds[w.start], kinds[w.end - 1]
        two = pair_hash(w.hash[:-1], w.hash[1:]) if len(w.hash) > 1 else w.hash[:0]
        four = pair_hash(two[:-2], two[2:]) if len(two) > 2 else two[:0]
        eight = pair_hash(four[:-4], four[4:]) if len(four) > 4 else four[:0]
        at = 1
        for i, t in enumerate(part):
            row, a, b = out[lo + i], w.bounds[i], w.bounds[i + 1]
            n, size = b - a, len(t)
            row[:N_CLASS] = np.bincount(kinds[at : at + size], minlength=N_CLASS) / max(1, size)
            at += size + 1
            lines = [x for x in t.split(b"\n") if x.strip()]
            k = N_CLASS
            row[k] = np.log1p(n)
            row[k + 1] = np.log1p(size)
            row[k + 2] = 1 - len(set(lines)) / len(lines) if lines else 0
            row[k + 3] = np.log1p(len(lines))
            if n:
                ln = length[a:b]
                h = np.sort(w.hash[a:b])
                ends = np.flatnonzero(np.append(h[1:] != h[:-1], True))
                row[k + 4], row[k + 5] = ln.mean(), ln.std()
                row[k + 6] = len(ends) / n
                row[k + 7] = np.diff(ends, prepend=-1).max() / n
                row[k + 8] = (last[a:b] == 6).mean()
                row[k + 9] = ((first[a:b] == 2) & ((last[a:b] == 2) | (last[a:b] == 7))).mean()
                row[k + 10] = (ln <= 3).mean()
            for k, h, m in ((N_CLASS + 11, two, 1), (N_CLASS + 12, eight, 7)):
                if n > m:
                    row[k] = 1 - len(np.unique(h[a : b - m])) / (n - m)
    return out


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float32) for x in batch.column(name).to_pylist()], np.float64).reshape(-1, N_STATS)


class Model:
    def __init__(self, mean, scale, weights, knots, values):
        rng = np.random.default_rng(11)
        self.mean, self.scale, self.weights, self.knots, self.values = mean, scale, weights, knots, values
        self.w = rng.standard_normal((N_STATS, DIM)) / np.sqrt(N_STATS) * 1.5
        self.b = rng.uniform(0, 2 * np.pi, DIM)

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / DIM) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(x) @ self.weights, LOW, HIGH)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.interp(self.ridge(x), self.knots, self.values), 6)


def isotonic(centres: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over histogram bins: knots and non-decreasing values."""
    blocks: list[list[float]] = []  # ones, count, sum of centres
    for c, k, n in zip(centres, ones, counts, strict=True):
        if n:
            blocks.append([k, n, c * n])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                top = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([s / n for _, n, s in blocks]), np.array([k / n for k, n, _ in blocks])


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and x, the packed statistics of the whole text."""
    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("x", T.BinaryType())])

    def run(batches):
        for b in batches:
            x = statistics(to_bytes(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([r.tobytes() for r in x], pa.binary())], names=[*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def fit(labelled: DataFrame, ridge: float = 1e-3) -> Model | float:
    """Fit on rows (x, y); a constant when there are no labels or only one kind."""

    def moments(batches):
        total = np.zeros(2 * N_STATS + 2)
        for b in batches:
            x, y = _matrix(b, "x"), b.column("y").to_numpy(zero_copy_only=False)
            total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x), y.sum()]])
        return total if total[-2] else None

    m = partition_sum(labelled, moments)
    if m is None:
        return 0.5
    n = m[-2]
    if m[-1] in (0, n):
        return float(m[-1] / n)
    mean = m[:N_STATS] / n
    scale = np.sqrt(np.maximum(m[N_STATS:-2] / n - mean**2, 0))
    model = Model(mean, np.where(scale < 1e-6, 1.0, scale), None, None, None)

    def equations(batches):
        a, r = np.zeros((DIM + 1, DIM + 1)), np.zeros(DIM + 1)
        for b in batches:
            z = model.fourier(_matrix(b, "x"))
            a += z.T @ z
            r += z.T @ b.column("y").to_numpy(zero_copy_only=False)
        return np.concatenate([a.ravel(), r]) if a.any() else None

    s = partition_sum(labelled, equations)
    a, r = s[: (DIM + 1) ** 2].reshape(DIM + 1, DIM + 1), s[(DIM + 1) ** 2 :]
    model.weights = np.linalg.solve(a + ridge * n / DIM * np.eye(DIM + 1), r)

    def histogram(batches):
        total = np.zeros((2, BINS))
        for b in batches:
            at = ((model.ridge(_matrix(b, "x")) - LOW) / (HIGH - LOW) * BINS).astype(int).clip(0, BINS - 1)
            y = b.column("y").to_numpy(zero_copy_only=False)
            total += [np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)]
        return total.ravel() if total.any() else None

    ones, counts = partition_sum(labelled, histogram).reshape(2, BINS)
    model.knots, model.values = isotonic(LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS, ones, counts)
    return model


def score(measured: DataFrame, model: Model | float, keep: list[str]) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*(measured.schema[c] for c in keep), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            s = np.full(b.num_rows, model) if isinstance(model, float) else model.predict(_matrix(b, "x"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64())], names=[*keep, "score"])

    return measured.select(*keep, "x").mapInArrow(run, schema)


def op3_quality(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    measured = checkpointed(measure(docs, ["doc_id"]).withColumn("held_out", held))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    labelled = measured.where(~F.col("held_out")).join(labels, F.col("doc_id") == F.col("id")).select("x", "y")
    scored = score(measured, fit(labelled), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
