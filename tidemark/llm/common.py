"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words everywhere in this subpackage.
WS = r"[\x20\x09-\x0D]"
NON_WS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark only, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    One is chosen here only in local mode, where driver and executors are one process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def small_or_shuffled(keys: DataFrame, most: int = 200_000) -> DataFrame:
    """keys (a narrow, checkpointed table) to join with: broadcast up to `most` rows, else shuffled."""
    return F.broadcast(keys) if keys.count() <= most else keys


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def bounded_sample(docs: DataFrame, n: int, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",)) -> list:
    """At most n rows, those with the smallest hash of their id: a training sample of fixed size.

    The ids are chosen first, so that no task carries more texts than the sample has.
    """
    key = F.xxhash64(F.col(id_col).cast("string"))
    ids = docs.select(key.alias("_k")).distinct().orderBy("_k").limit(n)
    rows = docs.select(key.alias("_k"), *columns).join(F.broadcast(ids), "_k").orderBy("_k").drop("_k").limit(n)
    return rows.collect()
