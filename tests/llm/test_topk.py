import math
import random

import numpy as np
import pytest

from palimpsest.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, queries, k=5):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    scale = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and good(v)]
    out = []
    for q, v in {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in queries if i is not None and good(v)}:
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in scale if i != q and len(v) == len(w))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("query_block", [8192, 3])
def test_brute_force(spark, query_block):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3 / (d + 1)) for d in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000 + i, [0.5, 0.25]) for i in range(4)]
    rows += [(3000, None), (3001, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (3002, [float("nan")] * 6), (3003, [float("inf")] * 6)]
    rows += [(3004, []), (3005, []), (None, [0.9] * 6), rows[5], rows[5], (50, rows[50][1]), (3006, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA + ", score string")
    out = topk.top_k(df, df.where("vec_id % 50 = 0 OR vec_id IN (3004, 3006)"), query_block=query_block)
    assert got(out) == brute(rows, [r for r in rows if r[0] is not None and (r[0] % 50 == 0 or r[0] in (3004, 3006))])


def test_empty_tables_and_scores_beyond_doubles(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1e7, 1.0]), (2, [1e7, 2.0]), (3, [1e7, -3.0]), (4, [3e30, 1.0])], SCHEMA)
    assert got(topk.top_k(none, some)) == [] and got(topk.top_k(some, none)) == []
    out = got(topk.top_k(some, some.where("vec_id < 3")))
    assert [r[2] for r in out if r[0] == 1] == [4, 2, 3]
    assert [r[3] for r in out if r[0] == 1] == [2**63 - 1, 2560000000**2 + 256 * 512, 2560000000**2 - 256 * 768]


def test_the_search_stops_early():
    rng = np.random.default_rng(0)
    x = np.zeros((5000, 8))
    x[:, 0] = np.floor(rng.exponential(1000, 5000))
    x[:, 1:] = np.floor(rng.normal(0, 1, (5000, 7)))
    query = np.array([[100.0, 1, 0, -1, 0, 0, 2, 0]])
    best = topk.Best(np.array([-1]), 5)
    assert topk.threshold_search(best, query, np.arange(5000), x) < 1000
    assert best.score[0].tolist() == sorted((query @ x.T)[0].tolist(), reverse=True)[:5]
