import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import scoring
from palimpsest.llm.queries import queries

from .conftest import SCHEMA, documents, words


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, counted):
    one, two, out = Counter(), Counter(), []
    for _, t in counted:
        w = split(t)
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
    n = max(sum(one.values()), 1)
    for i, t in rows:
        w, s = split(t), 0.0
        for j, x in enumerate(w):
            if j and two[w[j - 1], x]:
                s += math.log10(two[w[j - 1], x] / one[w[j - 1]])
            else:
                s += math.log10((scoring.BACKOFF if j else 1) * max(one[x], 1) / n)
        out.append((str(i), len(w), pytest.approx(s, abs=1e-6)))
    return sorted(out, key=lambda r: (r[0], r[1]))


def got(df):
    return sorted(((str(r["doc_id"]), r["n_words"], r["score"]) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(words(40 + i, i, ["the", "of", "And", f"w{i % 4}", "x."]))) for i in range(30)]
    out += [(100, "the of " * 500), (101, None), (102, ""), (103, "single"), (None, "the of and"), (104, " ".join(words(9000, 1)))]
    return [*out, out[0], out[0]]


def test_scores_over_all_documents(spark, rows):
    docs = documents(spark, rows, SCHEMA + ", slice string, part string, score string, n_words string")
    out = scoring.score(docs)
    assert got(out) == brute(rows, rows)
    assert {r["doc_id"]: r["mean"] for r in out.collect()}[101] is None


def test_backoff_to_words(spark, rows):
    """Counts of other documents: pairs, and words, that were never counted."""
    assert got(scoring.score(documents(spark, rows), documents(spark, rows[::3]))) == brute(rows, rows[::3])


def test_empty_tables(spark, rows):
    assert got(scoring.score(documents(spark, []))) == []
    assert got(scoring.score(documents(spark, rows), documents(spark, []))) == brute(rows, [])


def others(rows, order):
    """Each row by the counts of all other rows, in plain Python."""
    out = []
    texts = [split(t) for _, t in rows]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in texts]
    of_all, n_all = sum(grams, Counter()), sum(map(len, texts))
    for (i, _), w, own in zip(rows, texts, grams, strict=True):
        def count(g, own=own):
            return of_all[g] - own[g]

        s = 0.0
        for j in range(len(w)):
            gram, back = tuple(w[max(0, j - order + 1) : j + 1]), 1.0
            while len(gram) > 1 and not count(gram):
                gram, back = gram[1:], back * scoring.BACKOFF
            s += math.log10(back * (count(gram) / count(gram[:-1]) if len(gram) > 1 else max(count(gram), 1) / max(n_all - len(w), 1)))
        out.append((str(i), len(w), pytest.approx(s, abs=1e-6)))
    return sorted(out, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_own_ngrams_are_left_out(spark, rows, order, monkeypatch):
    monkeypatch.setattr(scoring, "PARTITION_BYTES", 1 << 14)
    some = [r for r in rows if r[0] != 102][5:]
    assert got(scoring.score(documents(spark, some), order=order, leave_out=True)) == others(some, order)


def test_query_backs_off(spark, tmp_path):
    """Of words found nowhere else nothing is known but how many words there are."""
    rows = [(1, "a b c d e"), (2, "a b c x y"), (3, "q r s t"), (4, "b c d e")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = got(queries()["op3_scoring"](spark, str(tmp_path)))
    assert out == others(rows, 3)
    assert dict((r[0], r[2]) for r in out)["3"] == pytest.approx(math.log10(0.4 * 0.4**2 * 0.4**2 / 14**4))


def test_keys_take_hardly_more_than_random_gaps_hold():
    """12,000 keys of a partition of 102: log2(e x mean gap) bits each."""
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 2**64 // 102, 12_000, dtype=np.uint64))
    packed = scoring._packed(keys)
    assert (scoring._unpacked(pa.py_buffer(packed)) == keys).all()
    assert 8 * len(packed) / len(keys) < 1.01 * math.log2(math.e * float(keys[-1]) / len(keys))
    for few in ([], [0], [2**64 - 1], [3, 4, 2**64 - 1], list(range(300))):
        few = np.array(few, np.uint64)
        assert (scoring._unpacked(pa.py_buffer(scoring._packed(few))) == few).all()
