import hashlib
import re
from collections import Counter

import pytest

from palimpsest.llm import substrings

from .conftest import SCHEMA, documents, words


def brute(rows, window):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[s : s + window]) for _, w in texts for s in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = {p for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window, group_paths", [(35, 1 << 18), (6, 2), (1, 1)])
def test_brute_force(spark, window, group_paths):
    passage = words(50, 1)
    rows = [(i, " ".join(words(20 + i, i) + passage[i % 5 : 45 - i % 3] + words(30, -i))) for i in range(20)]
    rows += [(100 + i, " ".join(words(80, i, ["a", "b", "c"][: 1 + i % 3]))) for i in range(8)]
    rows += [(200, " ".join(words(17, 3) * 5)), (201, " \t\n".join(passage)), (202, None), (203, ""), (204, "one two")]
    rows += [rows[0], rows[0], (1, "other text here"), (None, rows[3][1]), (205, " ".join(words(20_000, 9) + passage))]
    docs = documents(spark, rows, SCHEMA + ", k1 string, start string, copies string, id string")
    assert got(substrings.remove_repeats(docs, window=window, group_paths=group_paths, task_paths=50)) == brute(rows, window)


def test_empty_table(spark):
    assert got(substrings.remove_repeats(documents(spark, []))) == []


def test_patterned_words_are_no_repeat(spark):
    from .test_words import two_patterns

    one, other = ("".join(x) for x in two_patterns())
    rest = words(40, 1)
    docs = documents(spark, [(1, " ".join([*rest[:20], one, *rest[20:]])), (2, " ".join([*rest[:20], other, *rest[20:]]))])
    assert [(r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()] == [(41, 0)] * 2


def test_rows_that_share_a_doc_id_are_joined_by_their_text(spark):
    shared = words(40, 2)
    rows = [(None, " ".join([*(f"own{i}x{j}" for j in range(10)), *shared])) for i in range(150)]
    found = substrings.remove_repeats(documents(spark, rows))
    assert {(r["n_words"], r["n_removed"]) for r in found.collect()} == {(50, 40)} and found.count() == 150
