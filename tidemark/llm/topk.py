"""Exact top-k search by Fagin's threshold algorithm.

Vectors are cut into blocks by a hash of their id. In each block every dimension has a sorted list.
For a query the lists are read from the end that helps it, round by round; each vector met is scored in
full (random access), and the round's frontier values bound what no list has shown yet. Reading stops
when that bound is below the k-th score, which is exact, ties included. Queries form blocks too, so a
task holds BLOCK vectors and QUERY_BLOCK queries at any input size. Blocks are searched in rounds, the first one, then
WIDEN times as many in all, and so on: a query's k-th score so far is at most its k-th score overall, so that later
blocks stop at a bound below it and yield no row below it. On evenly mixed blocks a round yields some WIDEN * k rows a
query, where blocks by themselves would yield k each. A window keeps the best k.

Edge cases: vectors that are null, empty or hold a null or non-finite component, and rows without an
id, take no part; vectors of different length count missing components as 0; rows that repeat a query's
id are never its candidates, other repeated rows each count; rows with one id and different vectors are queries of their
own, each with ranks from 1, and rows that repeat id and vector are one query; ties go to the smaller id; fewer than k
candidates give fewer rows; an empty table gives an empty result; other columns are ignored. Scores
must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

SCALE, BLOCK, QUERY_BLOCK = 1024, 4096, 2048
LEAST = -(1 << 63)
WIDEN = 8  # blocks searched by the end of a round, against those by the end of the one before


def threshold_top_k(matrix: np.ndarray, ids: np.ndarray, orders: np.ndarray, query: np.ndarray, own: int, k: int, least: int = LEAST) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of matrix for query, best first, without rows of id own and rows below least.

    orders[d] lists the rows by ascending component d.
    """
    n = len(ids)
    live = np.flatnonzero(query)
    seen = np.zeros(n, bool)
    seen[ids == own] = True
    scores, rows = np.zeros(0, matrix.dtype), np.zeros(0, np.int64)
    depth, step = 0, 16
    while True:
        until = min(n, depth + step)
        if len(live):
            met = np.concatenate([orders[d, n - until : n - depth] if query[d] > 0 else orders[d, depth:until] for d in live])
        else:
            met, until = np.arange(n), n
        fresh = np.zeros(n, bool)
        fresh[met] = True
        fresh = np.flatnonzero(fresh & ~seen)
        seen[fresh] = True
        rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, matrix[fresh] @ query])
        if least > LEAST:
            rows, scores = rows[scores >= least], scores[scores >= least]
        if len(rows) > k:
            best = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
        if until == n:
            break
        depth, step = until, step * 2
        bound = sum(query[d] * (matrix[orders[d, n - until - 1], d] if query[d] > 0 else matrix[orders[d, until], d]) for d in live)
        if bound < least or len(rows) == k and scores.min() > bound:
            break
    best = np.lexsort((ids[rows], -scores))
    return [(int(scores[i]), int(ids[rows[i]])) for i in best]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out if not out.size or np.abs(out).max() < 1 << 26 else out.astype(object)


def _search(k: int):
    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}).astype("int64")
        width = max(candidates["v"].map(len).max(), queries["v"].map(len).max())
        m, q, ids = _matrix(candidates["v"], width), _matrix(queries["v"], width), candidates["vec_id"].to_numpy(np.int64)
        orders = np.argsort(m, axis=0, kind="stable").T.copy()
        asked = zip(queries["vec_id"], queries["query"], queries["least"].tolist(), q, strict=True)
        out = [(own, no, v, s) for own, no, least, x in asked for s, v in threshold_top_k(m, ids, orders, x, own, k, least)]
        return pd.DataFrame(out, columns=["query_id", "query", "vec_id", "score"]).astype("int64")

    return search


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every query row."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))
    ok = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    valid = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ok)
    rows = checkpoint(valid.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("ask"), x.alias("v")))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("ask")).first()
    blocks, ask_blocks = max(1, -(-n // block)), max(1, -(-asked // query_block))
    spread = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    candidates = rows.select("vec_id", "v", spread(blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(ask_blocks - 1))).alias("qb"))
    # hashed apart from the candidates' blocks; rows that repeat both id and vector are one query
    queries = rows.where("ask").dropDuplicates(["vec_id", "v"]).withColumn("query", F.monotonically_increasing_id())
    queries = checkpoint(queries.withColumn("qb", spread(ask_blocks)))

    def searched(some: DataFrame, asks: DataFrame) -> DataFrame:
        asks = asks.toDF(*asks.columns)  # both sides come from the same rows: columns of its own
        return some.groupBy("b", "qb").cogroup(asks.groupBy("b", "qb")).applyInPandas(_search(k), "query_id long, query long, vec_id long, score long")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found, done = None, 0
    while done < blocks:
        until = min(blocks, max(1, done * WIDEN))
        asks = queries.withColumn("least", F.lit(LEAST))
        if found is not None:
            kth = found.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
            asks = queries.join(kth, "query", "left").withColumn("least", F.coalesce("kth", F.lit(LEAST))).drop("kth")
        asks = asks.withColumn("b", F.explode(F.sequence(F.lit(done), F.lit(until - 1))))
        more = searched(candidates.where(F.col("b").between(done, until - 1)), asks)
        ranked = (more if found is None else found.union(more)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        done = until
        if done < blocks:
            found = checkpoint(ranked.drop("rank"))
    return ranked.select("query_id", "rank", "vec_id", "score")
