"""From raw documents to encoded training text: five stages, each on all that the one before kept.

1. language: documents without a confidently predicted language, or implausible in it, go.
2. near_dedup: one document of each group of near duplicates (five-word shingles, 0.8) stays.
3. substrings: 50-byte strings that a document with a smaller id also has are cut from the texts.
4. mixing: documents are taken as often as the source weights ask for.
5. pieces: texts are encoded with seeded merge dropout.

All stages but the last return the columns of documents, further columns of any name included.

Defined results: null, blank and letterless texts go in the first stage, and so does all where no row has a
language to learn from; rows with a null id pass near_dedup and substrings as they are; rows that repeat an id
are one document to near_dedup, no source to each other in substrings, and share a decision in mixing; equal
rows are treated alike; texts of any length are whole; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm._common import drop_folder, read_documents, shared_folder
from vecloom.llm.langid import accepted, fit
from vecloom.llm.minhash import one_of_each
from vecloom.llm.mixing import repeated
from vecloom.llm.pieces import encode
from vecloom.llm.substrings import without_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, n=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeated(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substrings", substrings),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: Models and seeded encodings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is a Parquet table in the shared folder."""
    docs, folder = read_documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
