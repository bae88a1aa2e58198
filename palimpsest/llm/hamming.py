"""Approximate nearest neighbours by cosine: multi-index hashing of learned binary codes.

1. ``fit`` learns, on a bounded sample, how vectors of a length become codes of 256 bits:
   vectors are scaled to length 1 and centred, turned to their principal axes, and rotated
   so that the signs of the components lose least (iterative quantization); as many
   rotations from different starts as fill the code. The Hamming radius is learned too: the
   one within which ``COVERED`` of the sample's own nearest neighbours lie.
2. ``index`` writes every vector with its code.
3. ``search`` holds the index in blocks. A code is cut into 16 substrings of 16 bits, and a
   block has for each of them the rows by substring. Codes within the radius r = 16 t + a of
   a query agree with it up to t bits in one of the first a + 1 substrings, or up to t - 1
   in one of the others, so probing those buckets finds every one of them: the keys around the query's are listed,
   or the keys there are gone through where they are fewer. What is within the radius is
   scored on the original vectors in double precision.
4. Queries with fewer than k rows are searched again with twice the radius, until it holds
   every code.

Queries come to the driver and go out to all tasks in blocks of QUERY_BLOCK: the stated
query set against all rows, in blocks. Every other row goes through the index once a block.

The sample is the SAMPLE rows of smallest hash; the learned radius only grows too large
where there are more rows than that, as their neighbours are nearer. On vectors without
structure near neighbours are far in bits, about 100 of 256, and probing then meets a large
part of the rows; only what is within the radius is scored.

Defined cases: vectors that are NULL, all zero, or hold NULL, NaN or infinite components
take no part, nor do rows without vec_id; vectors of different lengths are not compared,
and lengths that the sample does not have are coded by seeded rotations that are not
learned, with the widest radius; ties go to the smaller vec_id; all rows of a query's own vec_id are left out; a candidate
row that is repeated counts as often as it is there, a repeated query row once; very large
and very small components neither overflow nor vanish; no candidates, no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_batches, staged

K = 5
BITS = 256
SUB_BITS = 16
TABLES = BITS // SUB_BITS
#: Vectors the codes are learned on, at most.
SAMPLE = 8192
#: Vectors of the sample whose neighbours the radius is learned from.
PROBES = 512
COVERED = 0.97
TURNS = 25
QUERY_BLOCK = 8192
#: Rows of a block of the index.
BLOCK = 1 << 16
#: Pairs of a query and a row that are looked at in one step.
STEP = 1 << 21

INDEX_SCHEMA = "vec_id bigint, vector array<double>, code array<bigint>"
RESULT_SCHEMA = "query bigint, query_id bigint, vec_id bigint, score double"

_KEYS = np.arange(1 << SUB_BITS, dtype=np.uint16)
#: All differences of two substrings, those of few bits first, and how many there are of up to t bits.
_DIFFERENCES = _KEYS[np.argsort(np.bitwise_count(_KEYS), kind="stable")]
_BALL = np.cumsum(np.bincount(np.bitwise_count(_KEYS), minlength=SUB_BITS + 1))


@dataclass(frozen=True)
class Model:
    """What makes vectors of one length codes, and the radius to search."""

    mean: np.ndarray
    axes: np.ndarray  # a column for each bit
    radius: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Codes of vectors of length 1, as four words each."""
        bits = (unit - self.mean) @ self.axes > 0
        return np.packbits(bits, axis=1).view(np.uint64)


def _usable(batch: pa.RecordBatch, column: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and vectors of the rows that take part; each vector times the power of two that makes it neither large nor small."""
    ids, vectors = batch.column("vec_id"), batch.column(column)
    present = np.array(ids.is_valid()) & np.array(vectors.is_valid())
    length = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # NULL becomes NaN
    first = np.cumsum(length) - length
    out = {}
    for size in np.unique(length[present & (length > 0)]).tolist():
        rows = np.flatnonzero(present & (length == size))
        x = data[(first[rows][:, None] + np.arange(size)).ravel()].reshape(len(rows), size)
        fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        x, rows = x[fine], rows[fine]
        if len(rows):
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
            out[size] = ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64), x
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _rotations(size: int, kept: int, seed: int) -> list[np.ndarray]:
    """As many seeded rotations of the kept axes as fill a code."""
    rng = np.random.default_rng(seed + size)
    return [np.linalg.qr(rng.standard_normal((kept, kept)))[0] for _ in range(-(-BITS // kept))]


def _blind(size: int, seed: int) -> Model:
    """For a length that was not in the sample."""
    kept = min(size, BITS)
    axes = np.concatenate([np.eye(size, kept) @ r for r in _rotations(size, kept, seed)], axis=1)
    return Model(np.zeros(size), axes[:, :BITS], BITS)


def _learned(x: np.ndarray, k: int, seed: int) -> Model:
    """The codes and the radius for vectors of length 1."""
    size = x.shape[1]
    kept = min(size, BITS)
    mean = x.mean(axis=0)
    main = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1][:, :kept]
    v, axes = (x - mean) @ main, []
    for r in _rotations(size, kept, seed):
        for _ in range(TURNS):
            left, _, right = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = right.T @ left.T
        axes.append(main @ r)
    model = Model(mean, np.concatenate(axes, axis=1)[:, :BITS], BITS)
    if len(x) <= k:
        return model
    codes, probes = model.codes(x), np.arange(0, len(x), max(1, len(x) // PROBES))
    near = x[probes] @ x.T
    near[np.arange(len(probes)), probes] = -np.inf
    best = np.argpartition(near, -k, axis=1)[:, -k:]
    far = _distances(codes[probes][:, None, :], codes[best])
    return Model(mean, model.axes, int(np.quantile(far, COVERED, method="higher")))


def fit(vectors: DataFrame, *, k: int = K, sample: int = SAMPLE, seed: int = 13) -> dict[int, Model]:
    """A model for each length among the ``sample`` rows of smallest hash; rows that are repeated are taken once."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("embedding IS NOT NULL")
    rows = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(sample).toArrow().combine_chunks()
    found = {}
    for batch in rows.to_batches():
        for size, (_, x) in _usable(batch, "embedding").items():
            found.setdefault(size, []).append(x / _norms(x)[:, None])
    return {size: _learned(np.unique(np.concatenate(x), axis=0), k, seed) for size, x in found.items()}


def index(vectors: DataFrame, models: dict[int, Model], *, seed: int = 13) -> DataFrame:
    """Every vector that takes part, in double precision, with its code; a written table."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = dict(shared.value)
        for batch in batches:
            for size, (ids, x) in _usable(batch, "embedding").items():
                if size not in models:
                    models[size] = _blind(size, seed)
                codes = models[size].codes(x / _norms(x)[:, None])
                yield pa.record_batch(
                    {
                        "vec_id": pa.array(ids),
                        "vector": _lists(x, pa.float64()),
                        "code": _lists(codes.view(np.int64), pa.int64()),
                    }
                )

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    return staged(in_batches(rows, code, INDEX_SCHEMA), "codes")


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel(), kind))


def _coded(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ids, vectors and codes of a batch of the index."""
    length = batch.column("vector").value_lengths().to_numpy()
    out = {}
    for size in np.unique(length).tolist():
        rows = batch if (length == size).all() else batch.filter(pa.array(length == size))
        x = rows.column("vector").flatten().to_numpy().reshape(-1, size)
        codes = rows.column("code").flatten().to_numpy().reshape(-1, BITS // 64)
        out[size] = rows.column("vec_id").to_numpy(), x, codes.view(np.uint64)
    return out


class Block:
    """Rows of one length, and for each substring the rows by its value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        self.ids, self.x, self.codes, self.norms = ids, x, codes, _norms(x)
        subs = np.ascontiguousarray(codes).view(np.uint16)
        self.rows = [np.argsort(subs[:, j], kind="stable") for j in range(TABLES)]
        # Where the rows of each key begin; one more entry for the end.
        self.at = [np.searchsorted(subs[r, j], np.arange((1 << SUB_BITS) + 1)) for j, r in enumerate(self.rows)]

    def within(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, row) whose codes differ in up to ``radius`` bits."""
        subs = np.ascontiguousarray(codes).view(np.uint16)
        met = np.zeros((len(codes), len(self.ids)), bool)
        t, a = divmod(min(radius, BITS), TABLES)
        for j in range(TABLES):
            bits = t if j <= a else t - 1
            if bits < 0:
                continue
            there = np.flatnonzero(np.diff(self.at[j])).astype(np.uint16)
            if _BALL[bits] < len(there):
                keys = subs[:, j, None] ^ _DIFFERENCES[None, : _BALL[bits]]
                query = np.repeat(np.arange(len(codes)), keys.shape[1])
                keys = keys.ravel()
            else:
                query, at = np.nonzero(np.bitwise_count(subs[:, j, None] ^ there[None, :]) <= bits)
                keys = there[at]
            keys = keys.astype(np.int64)
            low, count = self.at[j][keys], self.at[j][keys + 1] - self.at[j][keys]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            met[np.repeat(query, count), self.rows[j][np.repeat(low, count) + within]] = True
        query, row = np.nonzero(met)
        near = _distances(codes[query], self.codes[row]) <= radius
        return query[near], row[near]


def _best(who: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query."""
    order = np.lexsort((vec, -score, who))
    who, vec, score = who[order], vec[order], score[order]
    top = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[top], vec[top], score[top]


def search_block(block: Block, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, radius: int, k: int):
    """(query, vec_id, score) of the k best of a block within the radius, for every query."""
    found, step = [], max(1, STEP // max(len(block.ids), 1))
    norms = _norms(x)
    for low in range(0, len(ids), step):
        query, row = block.within(codes[low : low + step], radius)
        query = query + low
        other = block.ids[row] != ids[query]
        query, row = query[other], row[other]
        score = np.empty(len(query))
        for at in range(0, len(query), STEP // 16):
            q, r = query[at : at + STEP // 16], row[at : at + STEP // 16]
            score[at : at + STEP // 16] = np.einsum("ij,ij->i", x[q], block.x[r]) / (norms[q] * block.norms[r])
        found.append(_best(query, block.ids[row], score, k))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _searched(rows: DataFrame, queries: dict[int, tuple], radius: dict[int, int], k: int) -> DataFrame:
    """The k best of every task for every query of a block of queries."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, radius))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, radius = shared.value
        first, at = {}, 0
        for size, (ids, _, _) in queries.items():
            first[size], at = at, at + len(ids)
        best: dict[int, tuple] = {}
        held: dict[int, list] = {size: [] for size in queries}

        def flush(size: int) -> None:
            if not held[size]:
                return
            block = Block(*(np.concatenate(part) for part in zip(*held[size], strict=True)))
            held[size] = []
            new = search_block(block, *queries[size], radius[size], k)
            if size in best:
                new = _best(*(np.concatenate(pair) for pair in zip(best[size], new, strict=True)), k)
            best[size] = new

        for batch in batches:
            for size, found in _coded(batch).items():
                if size in queries:
                    for low in range(0, len(found[0]), BLOCK):
                        held[size].append(tuple(part[low : low + BLOCK] for part in found))
                        if sum(len(ids) for ids, _, _ in held[size]) >= BLOCK:
                            flush(size)
        for size in queries:
            flush(size)
        for size, (who, vec, score) in best.items():
            yield pa.record_batch(
                {
                    "query": pa.array(who + first[size], pa.int64()),
                    "query_id": pa.array(queries[size][0][who], pa.int64()),
                    "vec_id": pa.array(vec, pa.int64()),
                    "score": pa.array(score, pa.float64()),
                }
            )

    return in_batches(rows, search, RESULT_SCHEMA)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    candidates: DataFrame,
    queries: DataFrame,
    *,
    k: int = K,
    models: dict[int, Model] | None = None,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for every query. Both have columns vec_id and embedding."""
    models = fit(candidates, k=k) if models is None else models
    rows = index(candidates, models)
    wanted = index(queries.select("vec_id", "embedding").distinct(), models)
    rounds = -(-wanted.count() // query_block)
    result = None
    for r in range(rounds):
        mine = wanted.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(rounds)) == r).toArrow()
        going = _coded(mine.combine_chunks().to_batches()[0]) if mine.num_rows else {}
        radius = {size: models[size].radius if size in models else BITS for size in going}
        while going:
            found = staged(_ranked(_searched(rows, going, radius, k), k), "nearest")
            met = {row["query"] for row in found.where(F.col("rank") == k).select("query").toLocalIterator()}
            again, done, at = {}, [], 0
            for size, query in going.items():
                whole = radius[size] >= BITS
                enough = np.array([whole or at + i in met for i in range(len(query[0]))])
                done += (np.flatnonzero(enough) + at).tolist()
                at += len(enough)
                if not enough.all():
                    again[size] = tuple(part[~enough] for part in query)
            part = (found.where(F.col("query").isin(done)) if again else found).select("query_id", "rank", "vec_id", "score")
            result = part if result is None else result.unionByName(part)
            radius = {size: min(2 * max(radius[size], 1), BITS) for size in again}
            going = again
    if result is None:
        return candidates.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return result
