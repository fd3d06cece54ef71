"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into shards of about SHARD rows; in each, every dimension has a list of the shard's vectors sorted by that
component.  A query reads the lists in parallel, from the top where its component is positive and from the bottom where it
is negative, STEP entries at a time.  Each vector met for the first time gets its exact score by random access.  The bound on any
vector not yet met is the sum over dimensions of the query's component times the value last read.  Reading stops when the bound is less
than the kth score (not when equal: an unmet vector might tie with a smaller id).  The shards' winners are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 8192
#: Queries that meet a shard at once.
QUERIES = 512
STEP = 1 / 64


def threshold_top_k(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """(query row, vector row, score) of each query's k best rows by score, then id; rows of the query's own id are left out."""
    n, dims = vectors.shape
    x, q = np.ascontiguousarray(vectors, np.float64), np.asarray(queries, np.float64)
    if n and dims and np.abs(x).max() * max(np.abs(q).max(initial=0), 1) * dims < 2**24:
        x, q = x.astype(np.float32), q.astype(np.float32)  # still exact: whole numbers below 2**24
    lists = np.argsort(-x, axis=0, kind="stable").T.copy()  # by dimension, falling
    values = np.take_along_axis(x, lists.T, axis=0).T.copy()
    step, out = max(4, int(n * STEP)), []
    for i in range(len(q)):
        used = np.flatnonzero(q[i])
        weight, up = q[i, used], q[i, used] > 0
        met = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        depth = 0
        while depth < n:
            deep = min(n, depth + step)
            met_before = met.copy()
            met[lists[used[up], depth:deep].ravel()] = True
            met[lists[used[~up], n - deep : n - depth].ravel()] = True
            if not len(used):
                met[:] = True
            fresh = np.flatnonzero(met & ~met_before)
            if len(fresh):
                fresh = fresh[ids[fresh] != query_ids[i]]
                s = x[fresh] @ q[i]
                rows, scores = np.r_[rows, fresh], np.r_[scores, s.astype(np.float64)]
                if len(rows) > k:
                    kth = np.partition(scores, len(scores) - k)[-k]
                    keep = scores >= kth
                    rows, scores = rows[keep], scores[keep]
            depth = deep
            if not len(used):
                break
            bound = float(weight[up].astype(np.float64) @ values[used[up], depth - 1] + weight[~up].astype(np.float64) @ values[used[~up], n - depth])
            if len(rows) >= k and bound < scores.min():
                break
        best = np.lexsort((ids[rows], -scores))[:k]
        out.append((np.full(len(best), i), rows[best], scores[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        def arrays(t):
            lists = t.column("x").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            return t.column("vec_id").to_numpy(), size, flat

        ids, size, flat = arrays(left)
        qids, qsize, qflat = arrays(right)
        out = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)}
        if len(ids) and len(qids):
            dims = int(max(size.max(), qsize.max()))

            def dense(size, flat):  # a shorter vector is continued by zeros
                m = np.zeros((len(size), dims))
                m[np.arange(dims) < size[:, None]] = flat
                return m

            a, b, s = threshold_top_k(dense(size, flat), ids, dense(qsize, qflat), qids, k)
            out = {"query_id": qids[a], "vec_id": ids[b], "score": s.astype(np.int64)}
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "x") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of the vectors by inner product of whole numbers, ties to the smaller id.

    Both tables have an id and an array of whole numbers (any numeric type; products must stay below 2**53).  A row with a null id,
    a null vector or a null, NaN or infinite component takes no part.  A vector of other ids only competes; a query whose id is on several rows
    is asked once, with its least vector; a candidate id on several rows competes with each.  Fewer than k candidates give
    fewer rows; empty tables give an empty one.  Other columns are not read.
    """

    def clean(df: DataFrame) -> DataFrame:
        x = F.col(vector_col).cast("array<double>")
        ok = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        return df.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))

    vectors, queries = clean(vectors), clean(queries).groupBy("vec_id").agg(F.min("x").alias("x"))
    shards = max(1, -(-vectors.count() // SHARD))
    blocks = max(1, -(-queries.count() // QUERIES))
    # a stated query set against all rows, block by block: each shard meets each block of queries once
    left = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component as double) of each component; null and non-finite components stay as they are."""
    return F.transform(vector.cast("array<double>"), lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), v).otherwise(F.floor(v * scale).cast("double")))
