import hashlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import alignment
from palimpsest.llm.queries import op12_alignment

from .conftest import documents

NONE = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.public("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.public("piece_bpe_32k.model"))


def brute_force(rows, both):
    """(doc_id, measures) by walking through both rows of tokens with each library's own tokenizer."""
    of_a, of_b = both
    letters, names = alignment._byte_letters(), {i: t for t, i in of_a.get_vocab().items()}
    seen, all_links = [], Counter()
    for doc_id, text in rows:
        a = of_a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = of_b.encode(text or "")
        as_bytes = [bytes(letters[c] for c in names[i]) for i in a]
        pieces = [of_b.id_to_piece(i) for i in b]
        bs_bytes = [bytes([int(p[3:5], 16)]) if of_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(as_bytes) != whole or b"".join(bs_bytes) != whole:
            seen.append((doc_id, None))
            continue
        end_a, end_b = np.cumsum([len(x) for x in as_bytes]).tolist(), np.cumsum([len(x) for x in bs_bytes]).tolist()
        i = j = 0
        links, groups, mine, other = [], [], [], []
        while i < len(a):
            links.append((a[i], b[j]))
            mine += [i] if i not in mine[-1:] else []
            other += [j] if j not in other[-1:] else []
            if end_a[i] == end_b[j]:
                groups.append(",".join(str(a[k]) for k in mine) + "|" + ",".join(str(b[k]) for k in other))
                mine, other, i, j = [], [], i + 1, j + 1
            elif end_a[i] < end_b[j]:
                i += 1
            else:
                j += 1
        all_links.update(links)
        seen.append((doc_id, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = {}
    for (_, b), n in all_links.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, what in seen:
        if what is None:
            out.append((doc_id, *NONE))
            continue
        n_a, n_b, n_groups, links, digest = what
        n_best = sum(all_links[x] == best[x[1]] for x in links)
        out.append((doc_id, n_a, n_b, n_groups, len(links), n_best, sum(all_links[x] for x in links), digest))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, given, both):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    got = op12_alignment(spark, given)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found(got) == brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], both)


TEXTS = [
    "plain words, and more words",
    None,
    "",
    " ",
    "\n\t  two  spaces ",
    "▁ is what the pieces write for a space",
    "<|endoftext|> </s> <0x41> <unk> are text here",
    "naïve 漢字 🙂 \u0000 é ﬁ",
    "a" * 5000,
    "plain words, and more words",
    "word " * 20_000,
]


def test_defined_cases(spark, both, monkeypatch):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] + [(0, "plain words, and more words")]
    docs = documents(spark, rows, "doc_id bigint, text string, n_a bigint, slice string")
    got = found(alignment.align_documents(docs))
    assert got == brute_force(rows, both)
    assert (1, *NONE) in got and (5, *NONE) in got
    assert alignment.align_documents(docs.limit(0)).collect() == []
    assert found(alignment.align_documents(docs.where("doc_id IN (1, 2)"))) == [(1, *NONE), (2, *NONE)]


def test_copies_are_encoded_once(spark, given):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    twice = alignment.align_documents(docs.unionByName(docs)).collect()
    once = {r["doc_id"]: r for r in alignment.align_documents(docs).collect()}
    assert len(twice) == 2 * len(once)
    for r in twice:
        assert r["count_sum"] == 2 * once[r["doc_id"]]["count_sum"] and r["n_best"] == once[r["doc_id"]]["n_best"]


def test_slices_do_not_matter(both):
    import pyarrow as pa

    rows = [(i, t) for i, t in enumerate(TEXTS[:8]) if t]
    part = pa.record_batch(
        {"key": pa.array([str(i).encode() for i, _ in rows]), "text": pa.array([t for _, t in rows]), "copies": pa.array([i + 1 for i, _ in rows], pa.int64())}
    )
    a, b = alignment.tokenizers(alignment.public("byte_bpe_50k.json"), alignment.public("piece_bpe_32k.model"))

    def counted(batches):
        total = Counter()
        for batch in batches:
            last = batch.slice(batch.num_rows - 1)
            total.update(dict(zip(last.column("pairs")[0].as_py(), last.column("counts")[0].as_py(), strict=True)))
        return total

    one = counted([alignment._aligned_slice(part, 0, a, b)])
    each = counted([alignment._aligned_slice(part.slice(i, 1), i, a, b) for i in range(len(rows))])
    assert one == each and sum(one.values()) > 0
