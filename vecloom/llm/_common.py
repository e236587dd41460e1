"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import math
import tempfile
import time

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

#: Fixed value: a word is a run of bytes that are none of these.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where none is set and the session is local too."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="vecloom-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def drop_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(name: str, *tables: DataFrame) -> str:
    """name, or with as many underscores before it as no column of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def checkpointed(df: DataFrame, release: bool = False) -> DataFrame:
    """Cut the lineage through the folder in spark.checkpoint.dir, which all executors share.

    The result
    forgets its plan altogether: a checkpoint alone keeps the plan's partitionings and constraints, which
    double with every join of an iterative job. With release, the driver's garbage is collected at once, so
    that Spark's cleaner deletes the shuffle files that led here, and a job needs the disk of one phase.
    """
    spark = df.sparkSession
    shared_folder(spark)
    saved = df.checkpoint(eager=True)
    rows = saved._jdf.queryExecution().toRdd()
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, saved._jdf.schema(), False), spark)
    if release:
        del df, saved, rows
        released(spark)
    return out


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and checkpoints that no table in use needs.

    Py4J tells the JVM about dropped objects by a thread that looks once a second; collected before that, nothing goes.
    """
    gc.collect()
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    for _ in range(30):
        if not waiting:
            break
        time.sleep(0.1)
    time.sleep(0.1)
    spark._jvm.System.gc()


def text_bytes(df: DataFrame) -> int:
    """Bytes of df as the optimizer sees them if it reads files plainly; else texts are measured by a job."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = lambda p: int(str(p.stats().sizeInBytes()))
    leaves = plan.collectLeaves()
    total = sum(size(leaves.apply(i)) for i in range(leaves.length()))
    if total < 1 << 50 and size(plan) <= total:
        return size(plan)
    return df.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0


def group_count(df: DataFrame, mb_each: float, least: int = 1) -> int:
    """Number of groups so that each holds about mb_each of the input; it never changes a result."""
    return max(least, math.ceil(text_bytes(df) / (mb_each * 1e6)))


def grouping(groups: int) -> Column:
    """Group of each document; equal rows share a group, copies with other ids spread."""
    return F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(groups)).cast("int")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split into held-out and training rows."""
    return F.crc32(doc_id.cast("string")) % n


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE + "+"), lambda w: w != "")
