"""Exact top-k by inner product with the threshold algorithm over sorted lists.

Vectors are dealt to shards. A shard sorts each dimension once; a query walks all
of its dimensions' lists from the side that scores highest, scores what it meets,
and stops when no vector further down can reach its kth score. Queries come in
blocks, so a task holds one shard and one block, whatever the size of either table.
The k best of every shard meet in a ranking by query.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_ROWS = 8192
BLOCK_QUERIES = 512
# Places of every list read before the first look at the bound; twice as many each time after.
STRIDE = 32


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(vec_id, v)`` with ``v = floor(scale * x)``; vectors that are null or hold a null or non-finite part are left out."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull() & ~odd).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"),
    )


def threshold_search(ids: np.ndarray, data: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int):
    """``(ids, scores)`` of the k best rows for one query, ties to the smaller id.

    ``lists[d]`` holds the rows in ascending order of dimension d. The bound is
    the score of a vector with every dimension at its list's present place; the
    walk goes on while it equals the kth score, since a tie may lie ahead.
    """
    n = len(ids)
    dims = np.flatnonzero(query)
    if not len(dims):
        best = np.sort(ids[ids != own])[:k]
        return best, np.zeros(len(best), np.int64)
    seen = np.zeros(n, bool)
    best_ids, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    weights, up = query[dims], query[dims] > 0
    high, low = dims[up], dims[~up]
    depth, stride = 0, STRIDE
    while depth < n:
        stop = min(depth + stride, n)
        met = np.zeros(n, bool)
        met[lists[:, n - stop : n - depth][high]] = True
        met[lists[:, depth:stop][low]] = True
        fresh = np.flatnonzero(met & ~seen)
        seen |= met
        fresh = fresh[ids[fresh] != own]
        if len(fresh):
            scores = (data[fresh] @ query).astype(np.int64)
            best_ids, best_scores = np.concatenate((best_ids, ids[fresh])), np.concatenate((best_scores, scores))
            if len(best_ids) > k:
                least = np.partition(best_scores, -k)[-k]
                near = best_scores >= least
                best_ids, best_scores = best_ids[near], best_scores[near]
        if len(best_ids) >= k:
            edge = np.empty(len(query), np.int64)
            edge[high], edge[low] = lists[high, n - stop], lists[low, stop - 1]
            bound = int(data[edge[dims], dims].astype(np.int64) @ weights.astype(np.int64))
            if bound < int(np.partition(best_scores, -k)[-k]):
                break
        depth, stride = stop, 2 * stride
    order = np.lexsort((best_ids, -best_scores))[:k]
    return best_ids[order], best_scores[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``vectors`` with the highest inner product for each query.

    Both tables are ``(vec_id long, v array<long>)``. A row is no candidate of a
    query with its own id; repeated rows are candidates each; a vector shorter
    than another counts as zero beyond its end. No vectors or no queries: no rows.
    """
    shards = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    salt = F.monotonically_increasing_id()
    own = vectors.select(
        "vec_id", "v", F.pmod(F.xxhash64("vec_id", salt), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    asked = queries.select(
        "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        ids = pdf["vec_id"].to_numpy(np.int64)
        width = max(map(len, pdf["v"]))
        if all(len(v) == width for v in pdf["v"]):
            data = np.stack(pdf["v"].to_list()).astype(np.int64)
        else:
            data = np.zeros((len(pdf), width), np.int64)
            for i, v in enumerate(pdf["v"]):
                data[i, : len(v)] = v
        # Doubles multiply whole numbers exactly up to 2**53, and much faster.
        top = float(np.abs(data).max(initial=0)) ** 2 * width
        data = data.astype(np.float64) if top < 2**53 else data
        rows, row_ids = data[~asks], ids[~asks]
        lists = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
        out = []
        for q, vector in zip(ids[asks].tolist(), data[asks]):
            found, scores = threshold_search(row_ids, rows, lists, vector, q, k)
            out.append(pd.DataFrame({"query_id": q, "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = own.unionByName(asked.select(*own.columns)).groupBy("shard", "block").applyInPandas(
        search, "query_id long, vec_id long, score long"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
