import math

import numpy as np
import pytest

from palimpsest.llm import hamming
from palimpsest.llm.queries import op13_neighbours

SCHEMA = "vec_id bigint, embedding array<double>, label string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)


def cosine(x, y):
    return sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x)) / math.sqrt(sum(b * b for b in y))


def brute_force(rows, queries, k=5):
    out = []
    for i, q in queries:
        scored = sorted((-cosine(q, v), j) for j, v in rows if j != i and len(v) == len(q))
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return out


def test_recall_and_scores_of_the_query(spark, given):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{given}/embeddings.parquet").collect()]
    want = brute_force(rows, [r for r in rows if r[0] % 50 == 0])
    got = [tuple(r) for r in op13_neighbours(spark, given).orderBy("query_id", "rank").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    met = {(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}
    assert len(met) >= 0.9 * len(want)
    by_id = dict(rows)
    for q, _, v, score in got:
        assert score == pytest.approx(cosine(by_id[q], by_id[v]), abs=1e-14)


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 40))
    model = hamming._learned(x / hamming._norms(x)[:, None], 5, 1)
    codes = model.codes(x / hamming._norms(x)[:, None])
    codes[1000:1100] = codes[0]  # many of one code
    codes[1100:1200, 1] ^= np.uint64(5)
    block = hamming.Block(np.arange(3000), x, codes)
    for radius in (0, 1, 15, 16, 17, 40, 90, 110, 256):
        query, row = block.within(codes[:60], radius)
        far = hamming._distances(codes[:60][:, None, :], codes[None])
        assert sorted(zip(query.tolist(), row.tolist(), strict=True)) == [tuple(p) for p in np.argwhere(far <= radius).tolist()]


def test_near_copies_are_found_with_a_small_radius(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 32))
    rows = [(i, (base[i % 300] + 0.01 * rng.standard_normal(32)).tolist()) for i in range(1800)]
    df = vectors(spark, rows).repartition(7)
    models = hamming.fit(df)
    assert models[32].radius < 40
    got = hamming.nearest(df, df.where("vec_id < 300"), models=models).collect()
    want = brute_force(rows, rows[:300])
    same = {(r["query_id"], r["vec_id"]) for r in got} & {(q, v) for q, _, v, _ in want}
    assert len(got) == 1500 and len(same) >= 0.97 * 1500


def test_defined_cases(spark):
    rows = [
        (1, [1.0, 0.0]),
        (2, [2.0, 0.0]),
        (3, [0.5, 0.0]),
        (4, [0.0, 1e300]),
        (5, [1e-300, 1e-300]),
        (6, None),
        (7, [0.0, 0.0]),
        (8, [float("nan"), 1.0]),
        (9, [float("inf"), 1.0]),
        (10, [None, 1.0]),
        (None, [1.0, 0.0]),
        (11, [1.0, 0.0, 0.0]),
        (12, []),
        (2, [2.0, 0.0]),
        (1, [1.0, 0.0]),
    ]
    df = vectors(spark, rows)
    got = [tuple(r) for r in hamming.nearest(df, df, k=4).orderBy("query_id", "rank").collect()]
    r2 = 1 / math.sqrt(2)
    want = {
        1: [(2, 1.0), (2, 1.0), (3, 1.0), (5, r2)],  # ties to the smaller id, a repeated row as often as it is there
        2: [(1, 1.0), (1, 1.0), (3, 1.0), (5, r2)],
        3: [(1, 1.0), (1, 1.0), (2, 1.0), (2, 1.0)],
        4: [(5, r2), (1, 0.0), (1, 0.0), (2, 0.0)],
        5: [(1, r2), (1, r2), (2, r2), (2, r2)],
    }
    assert [(q, n, v) for q, n, v, _ in got] == [(q, n, v) for q, found in want.items() for n, (v, _) in enumerate(found, 1)]
    assert [s for *_, s in got] == pytest.approx([s for found in want.values() for _, s in found])
    assert hamming.nearest(df, df.limit(0)).collect() == []
    assert hamming.nearest(df.limit(0), df).collect() == []


def test_queries_in_blocks_and_too_few_candidates(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(40)]
    df = vectors(spark, rows)
    got = [tuple(r) for r in hamming.nearest(df, df.where("vec_id < 20"), query_block=6, k=60).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [w[:3] for w in brute_force(rows, rows[:20], 60)]
