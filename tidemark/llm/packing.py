"""Packing by optimal length buckets.

The global histogram of lengths (words per text) is exact and grows with the number of different
lengths, not of rows: that is at most the square root of twice the words of all texts. Dynamic programming over
the histogram picks the bucket boundaries that minimise total padding. Inside each bucket, rows form
batches of floor(budget / padded length) rows, at least one.

Positions inside a bucket come from row numbers in hash shards of about SHARD_ROWS rows plus offsets of
the shards before, so no bucket is ever sorted in one task.

Edge cases: null and empty texts have length 0 and pack in a bucket of their own padded length 0 only
if the boundaries say so; a text longer than the budget is a batch by itself; repeated rows each get a
place; null ids pack like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NON_WS, checkpoint, text_or_empty

BUCKETS, TOKEN_BUDGET, SHARD_ROWS = 12, 16_384, 20_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Padded lengths, ascending, of at most `buckets` buckets with the least total padding.

    Cost of one bucket over lengths i..j is lengths[j] * rows - words; its split points are monotone, so
    each layer of the DP is divide and conquer: O(buckets * n log n).
    """
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate([[0.0], np.cumsum(counts.astype(np.float64))])
    words = np.concatenate([[0.0], np.cumsum(counts.astype(np.float64) * lengths)])
    size = lengths.astype(np.float64)
    best = size * rows[1:] - words[1:]
    cuts: list[np.ndarray] = []
    for _ in range(min(buckets, n) - 1):
        now, cut = best.copy(), np.full(n, -1, np.int64)
        stack = [(0, n - 1, 0, n - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            k = np.arange(a, min(b, mid - 1) + 1)  # the last length of the buckets before
            where = a
            if len(k):
                cost = best[k] + size[mid] * (rows[mid + 1] - rows[k + 1]) - (words[mid + 1] - words[k + 1])
                i = int(cost.argmin())
                where = int(k[i])
                if cost[i] < now[mid]:
                    now[mid], cut[mid] = cost[i], where
            stack += [(lo, mid - 1, a, where), (mid + 1, hi, where, b)]
        cuts.append(cut)
        best = now
    out, j = [], n - 1
    for cut in [*reversed(cuts), None]:
        if j < 0:
            break
        if cut is not None and cut[j] < 0:
            continue  # a further bucket would not lower the padding here
        out.append(int(lengths[j]))
        j = int(cut[j]) if cut is not None else -1
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """One row per input row: doc_id, n_tokens, bucket, padded_to, batch, slot, padding."""
    text = text_or_empty(text_col)
    rows = checkpoint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_count(text, F.lit(NON_WS + "++")).cast("long").alias("n_tokens")))
    histogram = rows.groupBy(F.col("n_tokens").alias("n")).count().orderBy("n").collect()
    bounds = optimal_boundaries(np.array([r["n"] for r in histogram], np.int64), np.array([r["count"] for r in histogram], np.int64), buckets)
    total = sum(r["count"] for r in histogram)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    # plain sums, for a lambda in a join key's definition breaks filter inference
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds), F.lit(0))
    shards = max(1, -(-total // SHARD_ROWS))
    placed = rows.withColumn("bucket", bucket).withColumn("_shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int"))
    counts = placed.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_n"))  # buckets * shards rows
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy("n_tokens", "doc_id"))
    numbered = placed.withColumn("_at", at).join(offsets, ["bucket", "_shard"])
    padded = F.try_element_at(edges, F.col("bucket") + 1)  # an empty table has no edge
    numbered = numbered.withColumn("padded_to", padded).withColumn("_place", F.col("_before") + F.col("_at") - 1)
    cap = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("padded_to"), F.lit(1))).cast("long"))
    return numbered.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_to",
        F.floor(F.col("_place") / cap).cast("long").alias("batch"),
        (F.col("_place") % cap).cast("int").alias("slot"),
        (F.col("padded_to") - F.col("n_tokens")).alias("padding"),
    )
