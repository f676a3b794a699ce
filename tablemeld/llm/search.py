"""Exact top-k search by inner product with MaxScore.

A component of a query is a term; its posting list in a shard is the column of that
component over the shard's vectors.  The largest and smallest value of a list bound what a
term can add to a score.  Terms are ordered by that range.  With the k-th best score so far
as threshold, the terms of smallest range that together cannot lift a vector over it are
non-essential: the postings of the essential terms are traversed for all vectors, and the
others are probed, largest range first, only for vectors that are still competitive.  The
best k of every shard are merged.

Queries and vectors are dealt to blocks of bounded size; every block of queries meets every
shard in a task of its own, and no task or the driver holds all of either.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemeld.llm.common import importable, materialize

SHARD, QUERY_BLOCK = 8192, 8192
#: Vectors of a shard that are scored in full to get a first threshold.
START = 256


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component; null for a vector that is null or holds null or non-finite ones."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(ok, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def best_of_shard(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best vectors of a shard for one query, ties to smaller ids.

    ``vectors`` has one row for each component (a posting list for each term).  The vector
    with id ``own`` takes no part.
    """
    terms = np.flatnonzero(query)
    lists = vectors[terms]
    q = query[terms]
    ends = np.stack([q * lists.min(1), q * lists.max(1)]) if len(terms) else np.zeros((2, 0), np.int64)
    low, high = ends.min(0), ends.max(0)
    order = np.argsort(low - high, kind="stable")
    q, lists, low, high = q[order], lists[order], low[order], high[order]
    # most that the terms from i on can still add; least is the sum over all terms
    rest = np.concatenate([np.cumsum(high[::-1])[::-1], [0]])
    span = np.concatenate([np.cumsum((high - low)[::-1])[::-1], [0]])
    least = low.sum()

    best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = min(START, len(ids))
    for a, b in ((0, first), (first, len(ids))):
        near = np.flatnonzero(ids[a:b] != own) + a
        full = len(scores) >= k
        threshold = scores.min() if full else None
        # essential terms: without them no vector gets over the threshold
        essential = int(np.argmax(least + span < threshold)) if full and least < threshold else len(q)
        total = np.zeros(len(near), np.int64)
        if len(near) == b - a:
            for i in range(essential):
                total += q[i] * lists[i, a:b]
        else:
            for i in range(essential):
                total += q[i] * lists[i, near]
        for i in range(essential, len(q)):
            competitive = total + rest[i] >= threshold
            near, total = near[competitive], total[competitive]
            total = total + q[i] * lists[i, near]
        best, scores = np.concatenate([best, near]), np.concatenate([scores, total])
        keep = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[keep], scores[keep]
    return best, scores


def _searched(k: int):
    def run(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            width = max(queries.v.map(len).max(), vectors.v.map(len).max())
            ids = vectors.vec_id.to_numpy()
            lists = _matrix(vectors.v, width)
            for own, mark, q in zip(queries.vec_id, queries["mark"], _matrix(queries.v, width).T, strict=True):
                places, scores = best_of_shard(ids, lists, q, own, k)
                out.extend((own, mark, i, s) for i, s in zip(ids[places].tolist(), scores.tolist(), strict=True))
        return pd.DataFrame(out, columns=["query_id", "mark", "vec_id", "score"]).astype("int64")

    return run


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as columns; missing last components are zero."""
    grid = np.zeros((width, len(column)), np.int64)
    for i, v in enumerate(column):
        grid[: len(v), i] = v
    return grid


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, ``rank`` (from 1), ``vec_id`` and integer ``score`` of each query's k best vectors.

    ``queries`` is a condition on rows of ``vectors``; a query's own id is no candidate.  Ties
    go to smaller ids.  Null ids, null vectors and vectors with null or non-finite components
    take no part; equal rows count once; a shorter vector is filled up with zeros; scores
    must fit 64 bits.  Different vectors of one id are queries of their own.
    """
    spark = importable(vectors.sparkSession)
    rows = vectors.select(
        F.col(f"`{key}`").cast("long").alias("vec_id"), scaled(F.col(f"`{vector}`"), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")
    ).dropna(subset=["vec_id", "v"])
    rows = rows.groupBy("vec_id", "v").agg(F.max("asked").alias("asked")).withColumn("mark", F.xxhash64("vec_id", "v"))
    rows = materialize(rows, "search-vectors")
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // QUERY_BLOCK))
    place = lambda count: F.pmod("mark", F.lit(count)).cast("int")
    everywhere = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    q = rows.filter("asked").select("vec_id", "mark", "v", place(blocks).alias("block"), everywhere(shards).alias("shard"))
    c = rows.select("vec_id", "v", place(shards).alias("shard"), everywhere(blocks).alias("block"))
    found = q.groupBy("block", "shard").cogroup(c.groupBy("block", "shard")).applyInPandas(_searched(k), "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
