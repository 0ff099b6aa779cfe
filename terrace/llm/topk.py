"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BLOCK = 512
GROUP_ROWS, BATCH_QUERIES = 1 << 16, 1 << 13
"""Rows and queries that one task holds at most, about: 33 MB of the one, 4 of the other at 64 components."""
LEAST_GROUP = 1 << 12
EXACT = 2.0**52


def scaled(vectors: DataFrame, id_col: str, vec_col: str, factor: float) -> DataFrame:
    """id and v: floor(factor * component) of the vectors that take part: neither null nor with null or non-finite components."""
    x = F.col("x")
    sound = F.col("x").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    df = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    return df.select("id", F.transform(x, lambda c: F.floor(F.lit(factor) * c)).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of int64; shorter vectors are filled up with 0, which adds nothing to a product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def top_of_block(q: np.ndarray, v: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (ascending in ids for equal scores) of the k best of a block for each query; ids ascend; own rows get no place."""
    exact = np.abs(q).max(initial=0).astype(float) * np.abs(v).max(initial=0) * max(1, q.shape[1]) < EXACT / len(ids)
    score = (q.astype(np.float64) @ v.astype(np.float64).T) if exact else (q @ v.T)
    keep = min(k, len(ids))
    same = own[:, None] == ids[None, :]
    if exact and keep < len(ids):
        rank = score * len(ids) - np.arange(len(ids))  # apart for all columns: the smaller id of equal scores first
        rank[same] = -np.inf
        at = np.argpartition(-rank, keep - 1, axis=1)[:, :keep]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(rank, at, 1), axis=1), 1)
    else:
        order = np.lexsort((np.broadcast_to(ids, score.shape), -score, same), axis=-1)
        at = order[:, :keep]
    gone = np.take_along_axis(same, at, 1)
    return np.where(gone, np.iinfo(np.int64).min, np.take_along_axis(score, at, 1).astype(np.int64)), np.where(gone, np.iinfo(np.int64).max, ids[at])


def search_tile(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of a tile's rows for each query: scores, ids (unused places: the least and greatest long), and the number of (query, block) pairs that were scored.

    Rows stand in document ranges of `block`. A block's bound for a query sums, component by component, the query's largest product with any value the
    block has there. Each query goes through its blocks from the largest bound down and ends where a bound falls below its k-th score.
    """
    width = max(q.shape[1], v.shape[1])
    q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, v))
    blocks = [slice(i, i + block) for i in range(0, len(ids), block)]
    high, low = (np.array([f(v[b], axis=0) for b in blocks], np.float64).reshape(len(blocks), width) for f in (np.max, np.min))
    bounds = np.maximum(q, 0).astype(np.float64) @ high.T + np.minimum(q, 0).astype(np.float64) @ low.T
    slack = 1 + np.abs(bounds) * 1e-9  # for bounds beyond exact doubles
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((len(qid), k), np.iinfo(np.int64).min)
    who = np.full((len(qid), k), np.iinfo(np.int64).max)
    active, scored = np.arange(len(qid)), 0
    for r in range(len(blocks)):
        b = order[active, r]
        go = bounds[active, b] + slack[active, b] >= best[active, -1]
        active, b = active[go], b[go]
        if not len(active):
            break
        scored += len(active)
        by = np.argsort(b, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(b[by])) + 1):
            rows, at = active[part], blocks[b[part[0]]]
            s, i = top_of_block(q[rows], v[at], ids[at], qid[rows], k)
            s, i = np.concatenate((best[rows], s), 1), np.concatenate((who[rows], i), 1)
            pick = np.lexsort((i, -s.astype(np.float64) if np.abs(s[s > np.iinfo(np.int64).min]).max(initial=0) < EXACT else ~s), axis=-1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
    return best, who, scored


def search(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, factor: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each query the k largest integer inner products (all, if fewer), ties to the smaller id.

    vectors and queries are scaled to floor(factor * component). Rows with a null id, a null vector, or null or non-finite components take no part. A query's own rows,
    those with its id, are no candidates; equal ids among queries are one query (the smallest vector), equal rows among candidates are candidates each.
    Every query meets every row in tiles of bounded size: a batch of queries against a group of rows, whose tops (k for each query and group) are merged by a sorted window.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vec_col, factor)
    asked = scaled(vectors if queries is None else queries, id_col, vec_col, factor).groupBy("id").agg(F.min("v").alias("v"))
    n, m = rows.count(), asked.count()
    groups = max(-(-n // GROUP_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_GROUP)), 1)
    batches = max(-(-m // BATCH_QUERIES), 1)
    left = rows.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("long").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("b"))
    right = asked.select("id", "v", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(batches)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))

    def tile(docs: pa.Table, asks: pa.Table) -> pa.Table:
        order = np.argsort(docs["id"].to_numpy(), kind="stable")
        ids, qid = docs["id"].to_numpy()[order], asks["id"].to_numpy()
        if not len(ids) or not len(qid):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "id", "score")})
        score, who, _ = search_tile(qid, matrix(asks["v"]), ids, matrix(docs["v"])[order], k)
        got = score > np.iinfo(np.int64).min
        return pa.table({"query_id": np.repeat(qid, got.sum(1)), "id": who[got], "score": score[got]})

    tops = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(tile, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return tops.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


