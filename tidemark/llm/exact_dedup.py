"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (Spark's freqItems, which keeps 1/support counters and never misses a digest
with more than support * N rows) proposes frequent digests; one exact count verifies them. The
verified winners, at most 1/support rows at any input size, are broadcast, so their rows are settled
map-side and never meet in one task. All other digests have at most support * N rows each and use an
ordinary shuffle. Only 64-character digests are shuffled, never texts.

Edge cases: null text counts as empty; white space runs count as one space (leading and trailing ones
too); of repeated rows with one id exactly one is kept; null ids are kept only where a group has no
other; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WS, checkpoint, text_or_empty

SUPPORT = 0.001


def digest(text_col: str = "text"):
    """Lowercase hex SHA-256 of the text with each run of white space replaced by one space."""
    return F.sha2(F.regexp_replace(text_or_empty(text_col), WS + "+", " "), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    d = checkpoint(
        docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("text_sha256"), F.monotonically_increasing_id().alias("_row"))
    )
    total = d.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_row"))).alias("_first")
    size = F.count(F.lit(1)).alias("group_size")
    candidates = d.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    winners = (
        d.join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256")
        .agg(size, first)
        .where(F.col("group_size") >= max(2.0, support * total))
    )
    winners = checkpoint(winners)  # at most 1/support rows
    frequent = d.join(F.broadcast(winners), "text_sha256")
    rest = d.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(size, first)
    both = frequent.unionByName(rest.join(groups, "text_sha256"))
    return both.select(
        "doc_id",
        F.col("_first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_first._row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    decided = checkpoint(exact_dedup(docs, id_col, text_col, support).select("doc_id", "keep_id", "kept", "text_sha256"))
    key = lambda id_, text: F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), text).alias("__kept_key")
    kept = decided.where("kept").select(key(F.col("doc_id"), F.col("text_sha256")))
    out = docs.withColumn("__kept_key", key(F.col(id_col), digest(text_col))).join(kept, "__kept_key", "left_semi")
    if not decided.where("NOT kept AND doc_id <=> keep_id").isEmpty():  # whole rows repeat
        out = out.dropDuplicates(["__kept_key"])
    return out.drop("__kept_key")
