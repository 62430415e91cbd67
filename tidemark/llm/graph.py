"""Connected components: alternating large and small stars, in DataFrames.

A graph of at most SMALL edges, a checked bound of some MB, is settled by one union-find task instead,
which saves a few hundred tiny shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

SMALL = 1_000_000


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for rows in batches:
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    yield pd.DataFrame([(x, find(x)) for x in list(root)], columns=["node", "label"]).astype("int64")


def components(edges: DataFrame, most_rounds: int = 50, small: int = SMALL) -> DataFrame:
    """node, label (the component's smallest node) of every node with an edge; edges: a, b (long)."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpoint(e)
    if e.count() <= small:
        return checkpoint(e.coalesce(1).mapInPandas(_united, "node long, label long"))
    mark = None
    for _ in range(most_rounds):
        e = checkpoint(_small(_large(e)))
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
