"""Alignment of two tokenizers' tokens by byte ranges, each distinct text once.

1. Documents are shuffled by their full text, copies being counted before they move, so
   that a text is one row however many documents hold it.
2. Every distinct text is encoded by both tokenizers, and the two rows of byte ranges are
   laid over each other. Both cut the same bytes without gaps, so the ends of all tokens
   cut the bytes into pieces, each in one A and one B token: a piece is a link. Ends
   that both have close a group. Texts come in slices of some megabytes; a slice's distinct
   id pairs are one list, with what they count for, copies included, and its texts point
   into that list.
3. The counts of the slices' pairs are added up by pair, and the highest of each B id, of
   which there are as many as its vocabulary has entries, is marked. Joined back to the
   lists, a common pair is one row a slice.
4. A slice's counts meet its texts, whose measures go to the documents by the digest of the text.

A is a byte-level BPE vocabulary in JSON, used as ranks; B is a sentencepiece model. Both
files are parameters; by default they are those of the installed package of public
tokenizers.

Defined cases: NULL and empty texts, and texts that one of the tokenizers does not give
back byte by byte, have no tokens: counts are 0, and the digest is the empty string. Every row
of documents gets its row, repeated ones and those without doc_id too. Strings of special
tokens are plain text. Texts are never cut. An empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from importlib.util import find_spec
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, ship, staged
from .words import slices

#: Bytes of text of a slice, whose distinct pairs are one list.
SLICE = 4 << 20
#: Bytes of text that are encoded at once.
PIECE = 1 << 18
#: Ids of B are below this.
B_IDS = 1 << 20

ALIGNED_SCHEMA = (
    "slice bigint, key binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
    " at array<int>, links array<int>, pairs array<bigint>, counts array<bigint>"
)
MEASURES = "key binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def public(name: str) -> str:
    """Where a file of the installed public tokenizers is."""
    spec = find_spec("public_tokenizers")
    return str((Path(spec.origin).parent if spec else Path("/opt/tokenizers")) / name)


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself if it can be seen, else the next beyond the first 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """Ids of texts, and the bytes of every id."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        # The decimal digits of every id, and room for what follows them.
        width = len(str(len(tokens))) + 1
        self.digits = np.zeros((len(tokens), width), np.uint8)
        names = [str(i).encode() for i in range(len(tokens))]
        for i, name in enumerate(names):
            self.digits[i, : len(name)] = np.frombuffer(name, np.uint8)
        self.n_digits = np.array([len(name) for name in names], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class ByteLevel(Tokenizer):
    """A byte-level BPE vocabulary in JSON."""

    def __init__(self, file: str) -> None:
        import tiktoken

        letters = _byte_letters()
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        super().__init__(tokens)
        self._of = tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._of.encode_ordinary(" " + t) for t in texts]


class Pieces(Tokenizer):
    """A sentencepiece model, which puts the space before a text itself."""

    def __init__(self, file: str) -> None:
        import sentencepiece

        self._of = sentencepiece.SentencePieceProcessor(model_file=file)
        n = self._of.get_piece_size()
        pieces = [self._of.id_to_piece(i) for i in range(n)]
        super().__init__(
            [
                bytes([int(p[3:5], 16)]) if self._of.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(pieces)
            ]
        )

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._of.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """Both, once a process."""
    return ByteLevel(a), Pieces(b)


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter((i for one in ids for i in one), np.int64, sum(map(len, ids)))


class Aligned:
    """Tokens of some texts, side by side."""

    def __init__(self, texts: list[str | None], a: Tokenizer, b: Tokenizer) -> None:
        plain = [t or "" for t in texts]
        of_a, of_b = a.encode(plain), b.encode(plain)
        for i, text in enumerate(plain):
            whole = (" " + text).encode()
            if not text or a.joined(of_a[i]) != whole or b.joined(of_b[i]) != whole:
                of_a[i], of_b[i] = [], []
        self.texts = len(texts)
        self.a, self.b, self._of_a, self._of_b = _flat(of_a), _flat(of_b), a, b
        self.n_a = np.array([len(x) for x in of_a], np.int64)
        self.n_b = np.array([len(x) for x in of_b], np.int64)
        end_a, end_b = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])
        ends = np.union1d(end_a, end_b)
        #: For each link its A and its B token, by place.
        self.link_a, self.link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        #: For each token the group it is in.
        self.group_a, self.group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        text_a = np.repeat(np.arange(self.texts), self.n_a)
        self.link_text = text_a[self.link_a]
        last = np.searchsorted(end_a, both)
        self.group_text = text_a[last]

    @property
    def n_groups(self) -> np.ndarray:
        return np.bincount(self.group_text, minlength=self.texts).astype(np.int64)

    @property
    def n_links(self) -> np.ndarray:
        return np.bincount(self.link_text, minlength=self.texts).astype(np.int64)

    def pairs(self) -> np.ndarray:
        """The id pair of each link, as one number."""
        return self.a[self.link_a] * B_IDS + self.b[self.link_b]

    def digests(self) -> list[str]:
        """Of each text the digest of its groups, written as ``a1,a2|b1;a3|b2,b3``."""
        n = len(self.a) + len(self.b)
        first_b = np.searchsorted(self.group_b, np.arange(len(self.group_text) + 1))
        first_a = np.searchsorted(self.group_a, np.arange(len(self.group_text) + 1))
        at_a = np.arange(len(self.a)) + first_b[self.group_a]
        at_b = np.arange(len(self.b)) + first_a[self.group_b + 1]
        width = max(self._of_a.digits.shape[1], self._of_b.digits.shape[1])
        cells, size = np.zeros((n, width), np.uint8), np.empty(n, np.int64)
        for at, ids, of in ((at_a, self.a, self._of_a), (at_b, self.b, self._of_b)):
            cells[at, : of.digits.shape[1]] = of.digits[ids]
            size[at] = of.n_digits[ids]
        after = np.full(n, ord(","), np.uint8)
        after[at_a[first_a[1:] - 1]] = ord("|")
        after[at_b[first_b[1:] - 1]] = ord(";")
        cells[np.arange(n), size] = after
        out = memoryview(cells[np.arange(width) <= size[:, None]])
        bytes_of = np.cumsum(np.r_[0, size + 1])
        ends = bytes_of[np.cumsum(self.n_a + self.n_b)].tolist()
        begins = [0, *ends[:-1]]
        # The mark after a text's last token is not part of it.
        return [hashlib.sha256(out[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(begins, ends, strict=True)]


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values, kind))


def _aligned_slice(part: pa.RecordBatch, number: int, a: Tokenizer, b: Tokenizer) -> pa.RecordBatch:
    """A row for every text of a slice, and one for its distinct pairs."""
    groups, digests, links, whose = [], [], [], []
    n_a, n_b = [], []
    done = 0
    for piece in slices([part], limit=PIECE):
        one = Aligned(piece.column("text").to_pylist(), a, b)
        groups.append(one.n_groups)
        n_a.append(one.n_a)
        n_b.append(one.n_b)
        digests += one.digests()
        links.append(one.pairs())
        whose.append(one.link_text + done)
        done += piece.num_rows
    whose, links = np.concatenate(whose), np.concatenate(links)
    pairs, at = np.unique(links, return_inverse=True)
    weight = part.column("copies").to_numpy()
    # Whole numbers below 2^53 are exact as weights.
    counts = np.bincount(at, weight[whose], len(pairs)).astype(np.int64)
    each, n = np.unique(whose * max(len(pairs), 1) + at, return_counts=True)
    text, place = each // max(len(pairs), 1), each % max(len(pairs), 1)
    rows = part.num_rows
    of_text = np.bincount(text, minlength=rows)
    n_links = np.bincount(whose, minlength=rows)

    def more(values: np.ndarray) -> pa.Array:
        return pa.concat_arrays([pa.array(values, pa.int64()), pa.nulls(1, pa.int64())])

    at_list, links_list = _lists(of_text, place, pa.int32()), _lists(of_text, n, pa.int32())
    return pa.record_batch(
        {
            "slice": pa.array(np.full(rows + 1, number), pa.int64()),
            "key": pa.concat_arrays([part.column("key"), pa.nulls(1, pa.binary())]),
            "n_a": more(np.concatenate(n_a)),
            "n_b": more(np.concatenate(n_b)),
            "n_groups": more(np.concatenate(groups)),
            "n_links": more(n_links),
            "groups_sha256": pa.array([*digests, None], pa.string()),
            "at": pa.concat_arrays([at_list, pa.nulls(1, at_list.type)]),
            "links": pa.concat_arrays([links_list, pa.nulls(1, links_list.type)]),
            "pairs": _lists(np.r_[np.zeros(rows, np.int64), len(pairs)], pairs, pa.int64()),
            "counts": _lists(np.r_[np.zeros(rows, np.int64), len(pairs)], counts, pa.int64()),
        }
    )


def align(texts: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Rows of (key, text, copies) as aligned texts and the pair lists of slices (``key`` NULL); a written table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(a_file, b_file)
        base, nth = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0
        for part in slices(batches, limit=PIECE):
            held.append(part)
            size += part.column("text").nbytes
            if size >= SLICE:
                yield _aligned_slice(_one(held), base + nth, a, b)
                held, size, nth = [], 0, nth + 1
        if held:
            yield _aligned_slice(_one(held), base + nth, a, b)

    return staged(in_batches(texts, encode, ALIGNED_SCHEMA), "aligned")


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    return table.to_batches()[0] if table.num_rows else held[0]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each id pair linked, and whether that is its B id's highest."""
    listed = aligned.where("key IS NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    counts = listed.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    counts = staged(counts, "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(B_IDS - 1))
    # One row for each entry of B's vocabulary at most.
    top = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _measured(counts: pa.Table, texts: pa.Table) -> pa.Table:
    """The measures of a slice's texts from the counts of its pairs."""
    place = counts.column("pos").to_numpy()
    n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    n[place] = counts.column("n").to_numpy()
    best[place] = counts.column("best").to_numpy(zero_copy_only=False)
    texts = texts.combine_chunks()
    at, links = (texts.column(c).combine_chunks() for c in ("at", "links"))
    text = np.repeat(np.arange(texts.num_rows), at.value_lengths().to_numpy(zero_copy_only=False))
    at, links = at.flatten().to_numpy(), links.flatten().to_numpy().astype(np.int64)

    def added(values: np.ndarray) -> pa.Array:
        total = np.zeros(texts.num_rows, np.int64)
        np.add.at(total, text, values)
        return pa.array(total)

    columns = {c: texts.column(c) for c in ("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    columns |= {"n_best": added(links * best[at]), "count_sum": added(links * n[at])}
    return pa.table({c: columns[c] for c in (x.split()[0] for x in MEASURES.split(", "))})


def measures(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The measures of every text: a slice's texts meet the counts of the slice's pairs, one slice at a time."""
    ship(aligned.sparkSession)
    listed = aligned.where("key IS NULL").select("slice", F.posexplode("pairs").alias("pos", "pair"))
    known = listed.join(counts, "pair").select("slice", "pos", "n", "best")
    texts = aligned.where("key IS NOT NULL").withColumn("of", F.col("slice")).drop("slice", "pairs", "counts")
    return known.groupBy("slice").cogroup(texts.groupBy("of")).applyInArrow(_measured, MEASURES)


def align_documents(docs: DataFrame, *, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    a_file, b_file = a_file or public("byte_bpe_50k.json"), b_file or public("piece_bpe_32k.model")
    text = F.col("text")
    key = F.unhex(F.sha2(text, 256))
    full = docs.where("text <> ''").select("text").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    aligned = align(staged(full.select(key.alias("key"), "text", "copies"), "texts"), a_file, b_file)
    found = staged(measures(aligned, pair_counts(aligned)), "measures")
    rows = docs.select("doc_id", key.alias("key")).join(found, "key", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
