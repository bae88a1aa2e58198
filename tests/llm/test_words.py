import re

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm.words import ALNUM, LETTER, LONG_WORD, NOT_SPACE, document_hashes, gram_starts, sequence_hashes, slices, split

TEXTS = ["", None, "  ", "a", " Ab\tcd\x0be ", "é ü—x", "a" * 5000, "x1-y2 Z", "end", "\x1c\x85 b", "a b a b"]


@pytest.mark.parametrize(
    "table, pattern, lower",
    [
        (NOT_SPACE, r"[^\x20\x09-\x0D]+", False),
        (NOT_SPACE, r"[^\x20\x09-\x0D]+", True),
        (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True),
        (LETTER, r"[A-Za-z\u0080-\U0010ffff]+", False),
    ],
)
def test_split_is_the_pattern(table, pattern, lower):
    found = split(pa.array(TEXTS), table, lower)
    low = {c: c + 32 for c in range(65, 91)} if lower else {}
    want = [re.findall(pattern, (t or "").translate(low)) for t in TEXTS]
    got = [bytes(found.data[a:b]).decode() for a, b in zip(found.start, found.end, strict=True)]
    assert [got[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)] == want
    data, bound = found.bytes_of()
    assert [bytes(data[a:b]).decode() for a, b in zip(bound[:-1], bound[1:], strict=True)] == [" ".join(w) for w in want]


def test_hashes_depend_on_the_words_alone():
    one, other = split(pa.array(["x a b c"]), NOT_SPACE, False), split(pa.array(["q", "a b c a b c d"]), NOT_SPACE, False)
    h, g = one.hashes(), other.hashes()
    assert h[1] == g[1] == g[4] and len({*h.tolist(), *g.tolist()}) == 6
    at = gram_starts(other.first, 3)
    assert at.tolist() == [1, 2, 3, 4, 5]
    grams = sequence_hashes(g, at, at + 3, 5)
    assert grams[0] == grams[3] == sequence_hashes(h, [1], [4], 5)[0]
    assert len(set(grams.tolist())) == 4


def test_slices_keep_rows_whole():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 50, "c" * 5, "", "d" * 5])})
    parts = list(slices(iter([batch]), limit=20))
    assert [p.num_rows for p in parts] == [2, 1, 3]
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
    assert np.all([p.num_rows for p in slices(iter([batch.slice(0, 0)]))] == [])


def two_patterns(steps=10):
    """Two sequences of a and b, each with the other's letters, that polynomials modulo a power of two cannot tell apart."""
    one = ["a"]
    for _ in range(steps):
        one += ["b" if x == "a" else "a" for x in one]
    return one, ["b" if x == "a" else "a" for x in one]


def test_patterned_words_and_sequences_differ():
    one, other = two_patterns()
    hashes = split(pa.array(["".join(one) + " " + "".join(other) + " " + "".join(one)]), NOT_SPACE, False).hashes()
    assert hashes[0] == hashes[2] != hashes[1]
    words = split(pa.array([" ".join(one), " ".join(other), " ".join(one)]), NOT_SPACE, False)
    h = words.hashes()
    for seed in (0, 1, 7):
        for found in (sequence_hashes(h, words.first[:-1], words.first[1:], seed), document_hashes(h, words.first, seed)):
            assert found[0] == found[2] != found[1]


def test_every_word_length_and_range_has_its_own_hash():
    text = " ".join("x" * n for n in (*range(1, 40), LONG_WORD - 1, LONG_WORD, LONG_WORD + 1, 5000))
    words = split(pa.array([text]), NOT_SPACE, False)
    h = words.hashes()
    assert len(set(h.tolist())) == len(h)
    same = np.full(50, h[0])
    found = sequence_hashes(same, np.zeros(50, int), np.arange(50), 3)
    assert len(set(found.tolist())) == 50
    assert len({int(sequence_hashes(h, [3], [9], seed)[0]) for seed in range(20)}) == 20
    assert len(set(document_hashes(same, np.array([0, 1, 3, 6, 6, 50]), 2).tolist())) == 5
