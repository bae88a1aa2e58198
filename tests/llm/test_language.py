import itertools

import numpy as np
import pytest

from palimpsest.llm import language

from .conftest import SCHEMA, documents


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(1)
    emissions, transitions = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 5, 5, 9])
    start, length = language.chains(first, size=4)
    assert sorted(zip(start.tolist(), length.tolist(), strict=True)) == [(0, 4), (4, 1), (5, 4)]
    out, pairs = language.marginals(emissions, transitions, start, length)
    want, want_pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for s, n in zip(start, length, strict=True):
        total, sums, seen = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = sum(emissions[s + t, k] for t, k in enumerate(path))
            weight = np.exp(weight + sum(transitions[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            for t, k in enumerate(path):
                sums[t, k] += weight
            for a, b in itertools.pairwise(path):
                seen[a, b] += weight
        want[s : s + n] = sums / total
        want_pairs += seen / total
    assert np.allclose(out, want) and np.allclose(pairs, want_pairs)


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, language.fit(language.sample(docs))


def test_held_out_documents(spark, fitted):
    docs, model = fitted
    rows = language.label_documents(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 100 and (rows["lang"] == rows["lang_pred"]).mean() >= 0.98
    assert rows["score"].between(0, 1).all()


def test_code_switched_text_is_labelled_piece_by_piece(spark, fitted):
    docs, model = fitted
    rows = docs.where("length(text) > 400 AND crc32(cast(doc_id AS string)) % 5 = 0").orderBy("doc_id").collect()
    some = {r["lang"]: " ".join(r["text"].split()[:25]) for r in rows}
    assert len(some) == 4
    text = " ".join(some[lang] for lang in ("en", "de", "fr", "es"))
    runs = language.label_runs(documents(spark, [(1, text), (2, some["de"]), (3, None)]), model).collect()
    mixed = sorted((r["first_word"], r["n_words"], r["lang"]) for r in runs if r["doc_id"] == 1)
    by_lang = {lang: sum(n for _, n, x in mixed if x == lang) for lang in some}
    assert all(n >= 15 for n in by_lang.values())
    assert [r["lang"] for r in runs if r["doc_id"] == 2 and r["n_words"] > 15] == ["de"]
    assert not [r for r in runs if r["doc_id"] == 3]


def test_inputs_are_text_and_language_of_learned_rows_only(spark, fitted):
    """Held-out labels, sources and ids change no prediction."""
    docs, model = fitted
    rows = docs.limit(50).selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source").collect()
    same = language.label_documents(documents(spark, [tuple(r) for r in rows]), model)
    want = {r["doc_id"]: r["lang_pred"] for r in language.label_documents(docs, model).collect()}
    assert all(want[r["doc_id"]] == r["lang_pred"] for r in same.collect())


def test_defined_cases(spark, fitted):
    _, model = fitted
    schema = SCHEMA + ", score string, has_letter string"
    rows = [(1, None), (2, ""), (3, "123 -- 4"), (4, "—…"), (None, "the of and to that"), (6, "the of and " * 20_000)]
    rows += [rows[4]]
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language.label_documents(documents(spark, rows, schema), model).collect())
    assert [g for g in got if g[0] in "1234"] == [(i, "und", 0.0) for i in "1234"]
    assert [g[1] for g in got if g[0] not in "1234"] == ["en"] * 3
    assert language.label_documents(documents(spark, []), model).count() == 0
    unlabelled = language.identify(documents(spark, rows))
    assert {(r["lang_pred"], r["score"]) for r in unlabelled.collect()} == {("und", 0.0)}
    kept = language.in_a_language(documents(spark, rows, schema), model, 0.4)
    assert kept.columns == documents(spark, [], schema).columns and kept.count() == 3


def test_text_that_switches_between_languages_is_kept(spark, fitted):
    """No language has 0.4 of the words, yet each word is in one for certain."""
    docs, model = fitted
    texts = {r["lang"]: r["text"].split() for r in docs.where("lang IS NOT NULL AND length(text) > 300").collect()}
    assert len(texts) >= 3
    mixed = documents(spark, [(1, " ".join(w for words in texts.values() for w in words[:40]))])
    assert language.label_documents(mixed, model).first()["score"] < 0.4
    assert language.in_a_language(mixed, model, 0.4).count() == 1
