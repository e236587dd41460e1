"""fvecs, ivecs and bvecs files: records of a little-endian int32 dimension and that many elements."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element type by kind of file, and the Spark type it is read as.
KINDS = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int"), "bvecs": ("u1", "double")}


def _dimension(spark: SparkSession, path: str) -> int:
    """The first four bytes of the first file that has any."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for g in store.globStatus(place) or [] for f in (store.listStatus(g.getPath()) if g.isDirectory() else [g])]
    for f in sorted(found, key=lambda f: f.getPath().toString()):
        if f.isFile() and f.getLen() >= 4 and not f.getPath().getName().startswith((".", "_")):
            stream = store.open(f.getPath())
            try:
                return int(spark._jvm.java.lang.Integer.reverseBytes(stream.readInt()))
            finally:
                stream.close()
    raise ValueError(f"no record in {path}")


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs", element: str | None = None) -> DataFrame:
    """idx and embedding of each record. Files are read in record-aligned splits, so one huge file is many tasks.

    The dimension comes from the first record; a record with another one, or a cut tail, is an error.
    """
    raw, spark_type = KINDS[kind]
    spark_type = element or spark_type
    dim = _dimension(spark, path)
    if dim <= 0:
        raise ValueError(f"dimension {dim} in {path}")
    size = 4 + dim * np.dtype(raw).itemsize
    records = spark.sparkContext.binaryRecords(path, size).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))

    def decode(batches):
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, size)
            dims = np.ascontiguousarray(rows[:, :4]).view("<i4").ravel()
            if (dims != dim).any():
                raise ValueError(f"dimensions differ: {dim} and {int(dims[dims != dim][0])}")
            values = np.ascontiguousarray(rows[:, 4:]).view(raw).ravel()
            offsets = pa.array(np.arange(len(rows) + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(values).cast({"float": pa.float32(), "double": pa.float64(), "int": pa.int32()}[spark_type]))], names=["idx", "embedding"])

    return spark.createDataFrame(records, "idx long, rec binary").mapInArrow(decode, f"idx long, embedding array<{spark_type}>")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """query_id, rank (from 1) and base_idx of an ivecs file."""
    rows = read_vecs(spark, path, "ivecs")
    return rows.select(F.col("idx").alias("query_id"), F.posexplode("embedding").alias("pos", "base_idx")).select("query_id", (F.col("pos") + 1).alias("rank"), "base_idx")


def write_vecs(rows: DataFrame, path: str, kind: str = "fvecs", order: str = "idx") -> int:
    """Write embeddings in order, one file a partition, into the folder path; returns the number of records."""
    raw = KINDS[kind][0]

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        where = "file://" + path[5:] if path.startswith("file:/") and "://" not in path else path
        store, folder = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
        store.create_dir(folder, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        # A retried task writes the same file again.
        with store.open_output_stream(f"{folder}/part-{part:05d}.{kind}") as out:
            for b in batches:
                for v in b.column(0).to_pylist():
                    out.write(np.int32(len(v)).astype("<i4").tobytes() + np.asarray(v).astype(raw).tobytes())
                    n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.orderBy(order).select("embedding").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
