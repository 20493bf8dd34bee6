"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Every dimension of a block of vectors is a list sorted by its component. A query reads each list sequentially: from
the top where its own component is positive, from the bottom where it is negative. After a round to depth r, an
entry's contribution is known where it was reached; elsewhere it lies between the list's far end and the last value
read. That gives every vector a lower and an upper bound. Vectors whose upper bound is below the k-th best lower
bound cannot qualify any more; reading stops when at most k are left, or the lists end, and the scores of what is left
are then resolved exactly.

Rounds are evaluated for many queries and a block of vectors at once. What a list has shown by depth r depends on the
query only through the sign of its component, so the bounds of all pairs are products of (positive part, negative
part) of the queries with the block's values clipped at the two reading positions.

Vectors and queries are cut into blocks by a hash of the id; one task handles a block of queries against a block of
vectors and returns k rows a query, which a final top-k merges. Nothing depends on the size of the whole tables but
the number of blocks. Directionless data (independent uniform directions) need nearly whole lists before the bounds
part; the work is then that of a full scan, times the number of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertloom.llm.texts import ship

K = 20
SCALE = 64
QUERY_BLOCK = 2048
VECTOR_BLOCK = 8192
DEPTHS = (0.5, 0.8, 0.93, 0.98)  # share of each list that is read by the end of a round; then the whole
QUERIES_AT_ONCE = 256


def whole(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x as double; null if the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of int64 components; shorter vectors end in zeros."""
    out = np.zeros((len(lists), dim), np.int64)
    sizes = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    if len(flat):
        rows = np.repeat(np.arange(len(lists)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _kind(q: np.ndarray, x: np.ndarray) -> type:
    """The cheapest type in which all sums of products are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def nra(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vector index, score) of each query's k best vectors (ids other than own), ties to smaller ids."""
    n, dim = x.shape
    kind = _kind(q, x)
    ranked = np.sort(x, axis=0)
    values = x.astype(kind)
    signed = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1).astype(kind)
    bottom, top = (ranked[0], ranked[-1]) if n else (np.zeros(dim, np.int64),) * 2
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(len(q))
    alive = np.ones(n, bool)  # vectors that can still qualify for some active query
    for depth in (*DEPTHS, 1.0):
        if not len(active) or not n:
            break
        read = min(n, int(np.ceil(depth * n)))
        down, up = ranked[n - read], ranked[read - 1]  # last values read from the top and from the bottom
        held = np.flatnonzero(alive)
        v = values[held]
        upper = np.concatenate([np.maximum(v, down), np.minimum(v, up)], axis=1).astype(kind)
        lower = upper if depth == 1.0 else np.concatenate([np.where(v >= down, v, bottom), np.where(v <= up, v, top)], axis=1).astype(kind)
        still, open_rows = [], np.zeros(len(held), bool)
        for at in range(0, len(active), QUERIES_AT_ONCE):
            rows = active[at : at + QUERIES_AT_ONCE]
            low = signed[rows] @ lower.T
            high = low if lower is upper else signed[rows] @ upper.T
            mine = own[rows][:, None] == ids[held][None, :]
            low = np.where(mine, np.array(-np.inf if kind is not np.int64 else np.iinfo(np.int64).min, kind), low)
            if len(held) > k:
                bar = np.partition(low, len(held) - k, axis=1)[:, len(held) - k][:, None]
                can = (high >= bar) & ~mine
            else:
                can = ~mine
            count = can.sum(axis=1)
            done = (count <= k) | (depth == 1.0)
            a, b = np.nonzero(can[done])
            if len(a):
                found.append(_resolved(q, x, ids, rows[done][a], held[b], k))
            still.append(rows[~done])
            open_rows |= can[~done].any(axis=0)
        active = np.concatenate(still)
        alive[:] = False
        alive[held[open_rows]] = True
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _resolved(q, x, ids, query, vector, k):
    """Exact scores of the pairs left, and of these the k best of each query."""
    score = np.concatenate([np.einsum("ij,ij->i", q[query[i : i + 65536]], x[vector[i : i + 65536]]) for i in range(0, len(query), 65536)])
    order = np.lexsort((ids[vector], -score, query))
    query, vector, score = query[order], vector[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], vector[keep], score[keep]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (vec_id, v) the k best of vectors (vec_id, v) but itself.

    v is an array<long> of components, null to take no part; null ids take no part either, ties go to the smaller
    vec_id, shorter vectors count as ending in zeros. Repeated rows of vectors with the same id and components count
    once; a query repeated likewise is answered once.
    Sums beyond 64 bits wrap around. Other columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    usable = lambda df: df.where("v is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v").distinct()
    queries, vectors = usable(queries), usable(vectors)
    row = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n_v, n_q = -(-row["n"] // VECTOR_BLOCK) or 1, -(-asked["n"] // QUERY_BLOCK) or 1
    dim = max(row["d"] or 0, asked["d"] or 0, 1)
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select(F.lit(True).alias("asks"), "vec_id", "v", block(n_q, 1).alias("bq")).withColumn("bv", every(n_v))
    right = vectors.select(F.lit(False).alias("asks"), "vec_id", "v", block(n_v, 2).alias("bv")).withColumn("bq", every(n_q))
    grid = left.select("bq", "bv", "asks", "vec_id", "v").unionByName(right.select("bq", "bv", "asks", "vec_id", "v"))

    def cell(data: pa.Table) -> pa.Table:
        asks = data["asks"].combine_chunks().to_numpy(zero_copy_only=False)
        ids = data["vec_id"].to_numpy()
        lists = data["v"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        m = _matrix(lists, dim)
        own, other = ids[asks], ids[~asks]
        query, vector, score = nra(m[asks], m[~asks], other, own, k)
        return pa.table({"query_id": own[query], "vec_id": other[vector], "score": np.asarray(score, np.int64)})

    near = grid.groupBy("bq", "bv").applyInArrow(cell, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
