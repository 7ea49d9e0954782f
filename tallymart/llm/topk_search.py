"""Exact top-k search by inner product: the threshold algorithm over sorted lists.

Rows are dealt into blocks, and every block keeps one list per dimension, sorted by
value.  For a query, all lists are read in parallel from the end that suits the sign of
the query's component.  Rows met get their full score at once; the components at the
depth reached give an upper bound for all rows not met, and reading stops when that
bound cannot beat the k-th best score.  The best k of each block meet in a last rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import session, table
from .registry import query

RESULT = "query_id long, vec_id long, score long, depth int"


def _matrix(t: pa.Table, dims: int, vec_id: str, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, one row per id (repeated rows count once), shorter vectors filled with 0."""
    ids = t.column(vec_id).to_numpy()
    out = np.zeros((len(ids), dims), np.int64)
    lists = t.column(vec).combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(len(ids)), ends)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    order = np.lexsort((*out.T[::-1], ids)) if len(ids) else np.empty(0, np.int64)
    ids, out = ids[order], out[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, bool)
    return ids[first], out[first]


def threshold_search(ids: np.ndarray, rows: np.ndarray, lists: np.ndarray, own: int, q: np.ndarray, k: int):
    """Best ``k`` of ``rows`` for ``q`` as (score, id) pairs, and the depth reached.

    ``lists[d]`` has the row numbers in ascending order of component ``d``.
    """
    n = len(ids)
    used = np.flatnonzero(q)
    rising, falling, weight = used[q[used] < 0], used[q[used] > 0], q[used]
    signs = weight > 0
    met = np.zeros(n, bool)
    seen = np.zeros(n, bool)
    best_score, best_id = np.empty(0, rows.dtype), np.empty(0, ids.dtype)
    depth, step, left = 0, max(8, n // 64), n
    while left:
        to = min(n, depth + step)
        if len(used):
            met[lists[falling, n - to : n - depth]] = True
            met[lists[rising, depth:to]] = True
            fresh = np.flatnonzero(met & ~seen)
            seen[fresh] = True
        else:  # every score is 0
            fresh, to = np.arange(n), n
        left -= len(fresh)
        scores = rows[fresh] @ q
        if len(best_score) == k:  # what cannot enter is left out before the ids are read
            fresh, scores = fresh[scores >= best_score[-1]], scores[scores >= best_score[-1]]
        elif len(scores) > k + 1:
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            fresh, scores = fresh[scores >= least], scores[scores >= least]
        keep = ids[fresh] != own
        best_score, best_id = np.concatenate([best_score, scores[keep]]), np.concatenate([best_id, ids[fresh][keep]])
        order = np.lexsort((best_id, -best_score))[:k]
        best_score, best_id = best_score[order], best_id[order]
        depth = to
        # A row not met may still tie with the k-th and have a smaller id, so the bound must be below it.
        if len(best_id) == k and left and len(used) and met_bound(rows, lists, used, signs, q, depth) < best_score[-1]:
            break
        step = 3 * depth
    return best_score, best_id, depth


def met_bound(rows, lists, used, signs, q, depth):
    """The highest score that a row below ``depth`` in every list can have."""
    n = len(rows)
    at = np.where(signs, lists[used, n - depth], lists[used, depth - 1])
    return q[used] @ rows[at, used]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, block_rows: int = 4096, query_rows: int = 512,
    vec_id: str = "vec_id", vec: str = "embedding",
) -> DataFrame:
    """The ``k`` highest integer inner products of each query row with all other rows.

    Components become ``floor(256 * x)``.  Vectors that are null or hold a null or
    non-finite component take no part, nor do rows without an id.  Rows that repeat an id
    count once (the smallest vector).  Ties go to the smaller id.  Missing components of
    shorter vectors count as 0.  Returns ``query_id, rank, vec_id, score, depth`` where
    depth is the deepest list position read for that row's block.

    Blocks of about ``block_rows`` rows and chunks of about ``query_rows`` queries bound
    what a task holds; the stated queries meet all rows block by block.
    """
    session(vectors.sparkSession)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = vectors.filter(F.col(vec_id).isNotNull() & F.col(vec).isNotNull()).filter(~bad).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    n, n_queries, dims = whole.agg(
        F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("vec")), F.lit(0))
    ).first()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-n_queries // query_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = whole.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), every(chunks).alias("chunk"))
    asked = whole.filter("asks").groupBy(F.col("vec_id").alias("ask_id")).agg(F.min("vec").alias("ask"))
    asked = asked.select("ask_id", "ask", every(blocks).alias("block"), F.pmod(F.xxhash64("ask_id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("depth", pa.int32())])
        if not left.num_rows or not right.num_rows:  # a block without rows or without queries
            return kinds.empty_table()
        ids, vecs = _matrix(left, dims, "vec_id", "vec")
        asking, qs = _matrix(right, dims, "ask_id", "ask")
        # Doubles hold these products exactly unless components are huge.
        big = max((int(np.abs(m).max()) for m in (vecs, qs) if m.size), default=0)
        if big * big * max(1, dims) < 1 << 53:
            vecs, qs = vecs.astype(np.float64), qs.astype(np.float64)
        lists = np.ascontiguousarray(np.argsort(vecs, axis=0, kind="stable").T)
        found: list[tuple[int, int, int, int]] = []
        for own, q in zip(asking.tolist(), qs):
            score, vec, depth = threshold_search(ids, vecs, lists, own, q, k)
            found += [(own, int(v), int(s), depth) for s, v in zip(score, vec)]
        return pa.table([pa.array([f[i] for f in found], kind.type) for i, kind in enumerate(kinds)], schema=kinds)

    part = ("block", "chunk")
    best = rows.groupBy(*part).cogroup(asked.groupBy(*part)).applyInArrow(search, RESULT)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")


SEARCH_SQL = """
WITH parts AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
           CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM parts a JOIN parts b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op9_topk_search", SEARCH_SQL)
def topk_search(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")
