"""Exact top-k search by inner product with the threshold algorithm.

Components become integers, floor(256 * x). Every task keeps its vectors in blocks; of a
block, each dimension is a sorted list, read from the top for queries positive in it and
from the bottom for negative ones. Vectors met in any list are scored in full (the random
access of the algorithm), and a query stops when the sum over the dimensions of what the
lists can still offer is below its k-th score. Scores carry over from block to block of a
task, so later blocks stop sooner; the best of all tasks are merged by rank. Depth
doubles from step to step, and the queries still going share the steps.

Queries come to the driver and go out to all tasks in blocks of QUERY_BLOCK: the stated
query set against all rows, in blocks.

Defined cases: vectors that are NULL, or hold NULL, NaN or infinite components take no
part; vectors of different lengths are not compared; ties go to the smaller vec_id; all
rows of a query's own vec_id are left out; a candidate row that is repeated counts as
often as it is there; a query row that is repeated counts once; a NULL vec_id takes no
part; scores beyond a long are set to the nearest long; no candidates, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_batches, staged

K = 5
SCALE = 256.0
QUERY_BLOCK = 8192
#: Candidates of a block.
BLOCK = 8192
FIRST_DEPTH = 8

RESULT_SCHEMA = "query bigint, query_id bigint, vec_id bigint, score bigint"


def usable(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and scaled vectors of the rows that take part, in order of id."""
    ids, vectors = batch.column("vec_id"), batch.column("embedding")
    present = np.array(ids.is_valid()) & np.array(vectors.is_valid())
    length = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten()
    data = values.to_numpy(zero_copy_only=False).astype(np.float64)  # NULL becomes NaN
    first = np.cumsum(length) - length
    out = {}
    for size in np.unique(length[present]).tolist():
        rows = np.flatnonzero(present & (length == size))
        x = data[(first[rows][:, None] + np.arange(size)).ravel()].reshape(len(rows), size)
        fine = np.isfinite(x).all(axis=1)
        x, who = np.floor(x[fine] * SCALE), ids.take(pa.array(rows[fine])).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(who, kind="stable")
        if len(who):
            out[size] = who[order], x[order]
    return out


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows; whole numbers below 2^53 are exact in doubles, others are added as integers."""
    largest = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if largest < 2**53:
        return q @ x.T
    whole = np.vectorize(int, otypes=[object])
    return (whole(q) @ whole(x).T) if q.size and x.size else np.zeros((len(q), len(x)))


class Best:
    """The k best of each query so far: scores and ids, best first."""

    def __init__(self, query_ids: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.score = np.full((len(query_ids), k), -np.inf)
        self.vec = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def offer(self, who: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        """Scores of vectors, in order of id, for the queries ``who``."""
        score = np.where(vec[None, :] == self.query_ids[who][:, None], -np.inf, score)
        k = min(self.k, score.shape[1])
        if k == 0:
            return
        bar = np.maximum(np.partition(score, -k, axis=1)[:, -k], self.score[who, -1])
        row, col = np.nonzero((score >= bar[:, None]) & (score > -np.inf))
        rows = np.r_[np.repeat(np.arange(len(who)), self.k), row]
        scores = np.concatenate([self.score[who].ravel(), score[row, col]])
        vecs = np.r_[self.vec[who].ravel(), vec[col]]
        order = np.lexsort((vecs, -scores.astype(np.float64), rows)) if scores.dtype != object else np.array(
            sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], vecs[i]))
        )
        rows, scores, vecs = rows[order], scores[order], vecs[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = nth < self.k
        if scores.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        self.score[who] = scores[top].reshape(len(who), self.k)
        self.vec[who] = vecs[top].reshape(len(who), self.k)


def threshold_search(best: Best, queries: np.ndarray, vec: np.ndarray, x: np.ndarray) -> int:
    """Search one block of candidates; how many of them were scored."""
    n = len(vec)
    by_value = np.argsort(x, axis=0, kind="stable")  # of each dimension, from the bottom to the top
    dims = np.arange(x.shape[1])
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    seen, going, depth = np.zeros(n, bool), np.arange(len(queries)), FIRST_DEPTH
    while len(going) and not seen.all():
        depth = min(depth, n)
        met = np.zeros(n, bool)
        if x.shape[1] == 0:
            met[:] = True
        met[by_value[n - depth :][:, (queries[going] > 0).any(axis=0)].ravel()] = True
        met[by_value[:depth][:, (queries[going] <= 0).any(axis=0)].ravel()] = True
        new = np.flatnonzero(met & ~seen)
        seen |= met
        best.offer(going, exact_products(queries[going], x[new]), vec[new])
        top, bottom = x[by_value[n - depth], dims], x[by_value[depth - 1], dims]
        bound = exact_products(up[going], top[None, :])[:, 0] + exact_products(down[going], bottom[None, :])[:, 0]
        # An unseen vector with just the k-th score could have a smaller id.
        going = going[(bound >= best.score[going, -1]).astype(bool)]
        depth *= 2
    return int(seen.sum())


def top_k(candidates: DataFrame, queries: DataFrame, *, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query.

    Both have columns vec_id and embedding.
    """
    queries = staged(queries.select("vec_id", "embedding").where("vec_id IS NOT NULL").distinct(), "queries")
    rounds = -(-queries.count() // query_block)
    found = None
    for r in range(rounds):
        mine = queries.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(rounds)) == r).toArrow()
        block = usable(mine.combine_chunks().to_batches()[0]) if mine.num_rows else {}
        rows = _searched(candidates.select("vec_id", "embedding"), block, k).withColumn("round", F.lit(r))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return candidates.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("round", "query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _searched(candidates: DataFrame, block: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The k best of every task for every query of a block."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = {size: Best(ids, k) for size, (ids, _) in block.items()}
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                for size, (vec, x) in usable(batch.slice(low, BLOCK)).items():
                    if size in block:
                        threshold_search(best[size], block[size][1], vec, x)
        at = 0
        for found in best.values():
            row, col = np.nonzero((found.score > -np.inf).astype(bool))
            score = found.score[row, col]
            if score.dtype == object:
                score = [min(max(int(s), -(2**63)), 2**63 - 1) for s in score]
            yield pa.record_batch(
                {
                    "query": pa.array(row + at, pa.int64()),
                    "query_id": pa.array(found.query_ids[row], pa.int64()),
                    "vec_id": pa.array(found.vec[row, col], pa.int64()),
                    "score": pa.array(np.asarray(score).astype(np.int64), pa.int64()),
                }
            )
            at += len(found.query_ids)

    return in_batches(candidates, search, RESULT_SCHEMA)


SQL = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= {K}
"""
