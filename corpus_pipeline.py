"""A training corpus from documents: identify, deduplicate exactly and nearly, redact, pack.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept, written as Parquet and
read again. All stages but the last return the columns of documents. A stage's files go once its successor's are there.

Edge cases, each as its operator states it: rows whose text is null or has no letter are rejected by language ID, so
the later stages see letters; repeated ids and null ids are told apart by id and text; whole rows that repeat keep one; an empty
table gives an empty result; columns beside those of documents pass through unchanged until packing, which drops them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, langid, ngram_join, packing, pii
from tidemark.llm.common import checkpoint_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what language ID rejects; a null lang takes the prediction."""
    return langid.keep_identified(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the one with the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join (five words, 0.8), keep one row, that of the smallest doc_id."""
    return ngram_join.drop_near_duplicates(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts; n_chars follows."""
    out = pii.redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

#: Models, components and bucket boundaries are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)  # its successor is written, so nothing reads it again
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
