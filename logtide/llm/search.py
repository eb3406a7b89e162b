"""Exact top-k search by inner product.

Queries are taken in blocks of a set number of rows; a block is broadcast
(its size is that number times the vector length) and every partition of the
candidates multiplies it with tiles of its vectors, keeping the ``k`` best of
each query. The partitions' lists are merged in two levels. A pass over the
candidates serves a whole block, nothing but short lists is shuffled, and no
task sees more than its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.order import dense_ids
from logtide.llm.store import cut

TILE_ROWS = 2048
_NONE = np.iinfo(np.int64).min
_EXACT = 2.0**51  # products below this are exact doubles and leave 11 bits for a place in the tile


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: array<double> of floor(scale * x). Rows with a null id or vector, or a null or non-finite component, are left out."""
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * float(scale)).cast("double"))
    return vectors.filter(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND {finite}").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the batch's rows, one for each vector length."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        at = offsets[rows][:, None] + np.arange(d)[None, :]
        yield ids[rows], flat[at] if d else np.zeros((len(rows), 0))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as int64; where doubles could round, in whole numbers of any length, held to the range of a long."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object).dot(np.array([[int(x) for x in r] for r in c], object).T)
    return np.clip(whole, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def _tile_best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best in a tile, ties to the smaller id; missing ones score _NONE."""
    order = np.argsort(ids, kind="stable")
    scores, ids = scores[:, order], ids[order]
    scores[own[:, None] == ids[None, :]] = _NONE
    n = scores.shape[1]
    if n > k and np.abs(scores[scores != _NONE]).max(initial=0) < _EXACT:
        # Score and place in one number, so equal scores differ and only k of them are picked.
        keys = np.where(scores == _NONE, _NONE, scores * TILE_ROWS + (TILE_ROWS - 1 - np.arange(n)))
        best = np.argpartition(keys, n - k, axis=1)[:, n - k :]
    else:
        best = np.argsort(-scores.astype(object), axis=1, kind="stable")[:, :k].astype(np.int64) if n > k else np.tile(np.arange(n), (len(own), 1))
    return np.take_along_axis(scores, best, 1), ids[best]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    s, i = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    order = np.lexsort((i, -np.maximum(s, _NONE + 1)), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _block_lists(candidates: DataFrame, block: list, k: int) -> tuple[DataFrame, Broadcast]:
    """query_id, vec_id, score: the k best of each query of the block in each partition; and what was sent for it."""
    by_length: dict[int, list] = {}
    for r in block:
        by_length.setdefault(len(r[1]), []).append(r)
    queries = {d: (np.array([r[0] for r in rs], np.int64), np.array([r[1] for r in rs], np.float64).reshape(len(rs), d)) for d, rs in by_length.items()}
    sent = candidates.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: (np.full((len(ids), 0), _NONE), np.full((len(ids), 0), 0)) for d, (ids, _) in sent.value.items()}
        for batch in batches:
            for ids, m in _matrices(batch):
                if m.shape[1] not in best:
                    continue
                own, q = sent.value[m.shape[1]]
                for at in range(0, len(ids), TILE_ROWS):
                    tile = _tile_best(_products(q, m[at : at + TILE_ROWS]), ids[at : at + TILE_ROWS], own, k)
                    best[m.shape[1]] = _merged(best[m.shape[1]], tile, k)
        for d, (s, i) in best.items():
            there = s != _NONE
            own = np.repeat(sent.value[d][0][:, None], s.shape[1], 1)
            yield pa.RecordBatch.from_arrays([pa.array(own[there]), pa.array(i[there]), pa.array(s[there])], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long"), sent


def _best_lists(lists: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the lists of the partitions merged, in two levels."""
    order = [F.col("score").desc(), F.col("vec_id")]
    some = lists.withColumn("_part", F.spark_partition_id() % 64)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*order))).filter(F.col("rank") <= k)
    last = Window.partitionBy("query_id").orderBy(*order)
    return some.select("query_id", "vec_id", "score", F.row_number().over(last).alias("rank")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query row.

    ``vectors`` has vec_id and embedding. The score is the inner product of the
    vectors floor(scale * x), exact, ties to the smaller vec_id. All rows but
    those with the query's own vec_id are candidates; of repeated ids each row
    counts as a candidate, and the smallest vector is the query. Vectors of
    another length than the query's are no candidates for it. Rows with a null
    vec_id take no part. Without candidates a query has no rows. Beyond what a
    64-bit integer holds (components from about 3.6e16 on, larger products), values stay at its ends.

    Blocks of ``block_rows`` queries are worked on one after the other: a
    block's lists are written before the next is collected and sent, so driver
    and executors hold one block.
    """
    whole = whole_vectors(vectors, scale)
    queries = whole.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = cut(dense_ids(queries, [F.col("vec_id")], "_no"), "queries")
    n = queries.count()
    lists = None
    for at in range(0, max(n, 1), block_rows):
        block = queries.filter((F.col("_no") >= at) & (F.col("_no") < at + block_rows)).select("vec_id", "v").collect()
        found, sent = _block_lists(whole, block, k)
        found = _best_lists(found, k)
        if n > block_rows:
            found = cut(found, "block_lists")
            sent.destroy()
        lists = found if lists is None else lists.unionAll(found)
    return lists
