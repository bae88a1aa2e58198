import hashlib
import re

import numpy as np
import pytest

from palimpsest.llm import decontamination as d

from .conftest import SCHEMA, documents, words


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        own, hit, names = split(text), set(), set()
        for item_id, item in items:
            want = split(item)
            size = min(len(want), window)
            for w in range(max(0, len(want) - size) + 1 if want else 0):
                for at in range(len(own) - size + 1):
                    if own[at : at + size] == want[w : w + size]:
                        hit |= set(range(at, at + size))
                        names.add("NULL" if item_id is None else str(item_id))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=repr)


def got(df):
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def case():
    few = ["the", "of", "a", "zeta"]
    items = [(i, " ".join(words(n, i, few if i % 2 else None))) for i, n in enumerate((3, 13, 14, 40, 1, 20))]
    items += [(7, None), (8, ""), (9, "..."), (None, " ".join(words(15, 99))), items[1], (10, items[1][1])]
    docs = [(i, " ".join(words(60, 100 + i, few if i % 3 == 0 else None))) for i in range(12)]
    for i, (_, text) in enumerate(items):
        docs.append((50 + i, " ".join(words(10, i)) + "! " + (text or "").upper().replace(" ", ", ") + " " + " ".join(words(5, i))))
    docs += [(1, None), (2, ""), (3, "-- --"), docs[14], docs[14], (None, items[3][1])]
    docs.append((90, " ".join(words(30_000, 5)) + " " + items[3][1]))
    return docs, items


@pytest.mark.parametrize("round_bytes", [1 << 20, 100])
def test_brute_force(spark, case, round_bytes):
    docs, items = case
    benchmark = documents(spark, items, "item_id bigint, text string, doc_id string, n_words string")
    clashing = documents(spark, docs, SCHEMA + ", n_words string, item_id string, start string")
    assert got(d.decontaminate(clashing, benchmark, round_bytes=round_bytes)) == brute(docs, items)


def test_empty_tables(spark, case):
    docs, items = case
    benchmark = documents(spark, items, "item_id bigint, text string")
    assert got(d.decontaminate(documents(spark, []), benchmark)) == []
    none = got(d.decontaminate(documents(spark, docs), benchmark.limit(0)))
    assert len(none) == len(docs) and not any(r[-1] for r in none)


def test_clean_documents_stay(spark, case):
    docs, items = case
    benchmark = documents(spark, items, "item_id bigint, text string")
    kept = d.without_contaminated(documents(spark, docs), benchmark)
    bad = {r[0] for r in brute(docs, items) if r[-1]}
    assert kept.columns == documents(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_proximity(spark):
    phrases = d.phrases_of([("p", "alpha beta gamma")])
    docs = documents(spark, [(1, "x gamma x alpha x beta x"), (2, "alpha x x x x x beta gamma"), (3, "alpha beta gamma")])
    postings = d.index(docs, phrases.vocabulary)
    near = {r["doc_id"]: len(r["start"]) for r in d.search(postings, phrases, slop=3).collect()}
    assert near[1] >= 1 and near[3] == 1 and near[2] == 0
    assert {r["doc_id"] for r in d.search(postings, phrases).collect() if r["start"]} == {3}


def test_the_search_starts_from_the_rarest_term():
    phrases = d.phrases_of([("p", "common rare common2")])
    df = np.zeros(3, np.int64)
    for word, n in (("common", 90), ("rare", 2), ("common2", 50)):
        df[phrases.terms[0, ["common", "rare", "common2"].index(word)]] = n
    assert d.rarest_first(phrases, df)[0, :3].tolist() == [1, 2, 0]


def test_patterned_words_are_no_hit(spark):
    from .test_words import two_patterns

    one, other = ("".join(x) for x in two_patterns())
    items = spark.createDataFrame([("x", one)], "item_id string, text string")
    found = {r["doc_id"]: r["n_hit"] for r in d.decontaminate(documents(spark, [(1, one), (2, other)]), items).collect()}
    assert found == {1: 1, 2: 0}
