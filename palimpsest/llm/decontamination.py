"""Benchmark decontamination by a distributed positional inverted index.

One pass over the documents builds the index: for each slice of some megabytes of text,
the postings (term by term, the positions in ascending order) of the words that the
benchmark uses. It is a stored table, cut by documents, so the lists of one document are
always together and intersecting them moves no posting. Document frequencies over all
slices say which of a phrase's terms is rarest. A search starts from the postings of the
rarest term, shifted by its offset in the phrase, and keeps the starts that are also in
the shifted list of the next rarest term, and so on; what is left are exact matches.

Words: A-Z made lower case, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Defined cases: NULL or empty texts have no words and no hits; an item without words
matches nothing; repeated rows of documents each get their row; repeated items count once
by item_id; a NULL item_id is called "NULL"; an empty benchmark leaves all documents
clean; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, staged
from .words import ALNUM, slices, split

WINDOW = 13
#: Bytes of benchmark text a task holds at once; a larger benchmark is searched in rounds.
ROUND_BYTES = 64 << 20
#: Starts looked at together in a search.
STARTS = 1 << 18

INDEX_SCHEMA = (
    "doc_id array<bigint>, text_key array<bigint>, first array<bigint>, term array<int>, upto array<int>,"
    " df array<int>, position binary"
)
MATCH_SCHEMA = "doc_id bigint, text_key bigint, n_words bigint, start array<int>, length array<int>, item array<string>"
RESULT_SCHEMA = (
    "doc_id bigint, text_key bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string,"
    " contaminated boolean"
)


@dataclass
class Phrases:
    """Distinct word sequences to look for, as numbers of the terms; -1 fills short rows."""

    vocabulary: np.ndarray  # hashes of the words, ascending; a term is its place in here
    terms: np.ndarray
    length: np.ndarray
    items: list[list[str]]  # of each phrase, the items it comes from


def phrases_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases:
    """The windows of each item; an item of fewer words, but not none, is one window."""
    words = split(pa.array([t for _, t in items], pa.large_string()), ALNUM, lower=True)
    hashes = words.hashes()
    vocabulary, term = np.unique(hashes, return_inverse=True)
    found: dict[bytes, set[str]] = {}
    for i, (item_id, _) in enumerate(items):
        own = term[words.first[i] : words.first[i + 1]].astype(np.int32)
        if len(own):
            for start in range(max(1, len(own) - window + 1)):
                found.setdefault(own[start : start + window].tobytes(), set()).add(item_id)
    rows = np.full((len(found), window), -1, np.int32)
    length = np.zeros(len(found), np.int32)
    for i, key in enumerate(found):
        own = np.frombuffer(key, np.int32)
        rows[i, : len(own)], length[i] = own, len(own)
    return Phrases(vocabulary, rows, length, [sorted(x) for x in found.values()])


def text_key() -> Column:
    """Tells rows apart that share a doc_id and have other texts."""
    return F.xxhash64("text")


def index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The stored index: a row per slice, with the postings of the words in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select("doc_id", "text", text_key().alias("text_key"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches):
            words = split(part.column("text"), ALNUM, lower=True)
            hashes = words.hashes()
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            position = np.flatnonzero(known[at] == hashes) if len(known) else np.zeros(0, np.int64)
            term = at[position].astype(np.int32)
            order = np.argsort(term, kind="stable")
            term, position = term[order], position[order].astype(np.int32)
            last = np.flatnonzero(np.r_[term[1:] != term[:-1], True]) if len(term) else np.zeros(0, np.int64)
            doc = words.doc[position]
            new = np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])] if len(term) else np.zeros(0, bool)
            df = np.diff(np.r_[0, np.cumsum(new)[last]]) if len(term) else last
            yield pa.record_batch(
                {
                    "doc_id": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "text_key": pa.array([part.column("text_key").to_pylist()], pa.list_(pa.int64())),
                    "first": pa.array([words.first], pa.list_(pa.int64())),
                    "term": pa.array([term[last]], pa.list_(pa.int32())),
                    "upto": pa.array([last + 1], pa.list_(pa.int32())),
                    "df": pa.array([df], pa.list_(pa.int32())),
                    "position": pa.array([position.tobytes()], pa.binary()),
                }
            )

    return staged(in_batches(rows, build, INDEX_SCHEMA), "index")


def document_frequencies(postings: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents of the whole corpus each term is. At most a row per term comes to the driver."""
    pairs = postings.select(F.explode(F.arrays_zip("term", "df")).alias("x")).select("x.term", "x.df")
    out = np.zeros(n_terms, np.int64)
    for r in pairs.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def rarest_first(phrases: Phrases, df: np.ndarray) -> np.ndarray:
    """For each phrase its offsets, that of the rarest term first, missing ones last."""
    cost = np.where(phrases.terms >= 0, df[np.maximum(phrases.terms, 0)], np.iinfo(np.int64).max)
    return np.argsort(cost, axis=1, kind="stable").astype(np.int32)


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and places of all of low[i]..high[i]-1."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def matches(
    phrases: Phrases,
    order: np.ndarray,
    first: np.ndarray,
    term: np.ndarray,
    upto: np.ndarray,
    position: np.ndarray,
    slop: int | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Phrase numbers and starts of the matches in a slice.

    Without ``slop`` a match is exact. With it, it is a position of the rarest term with
    every other term of the phrase at most ``slop`` words away in the same document,
    in any order.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(term) or not len(phrases.terms):
        return none
    low, high = np.r_[0, upto[:-1]].astype(np.int64), upto.astype(np.int64)
    keys = (np.repeat(term, high - low).astype(np.int64) << 32) | position.astype(np.int64)
    rows = np.arange(len(phrases.terms))
    rarest = phrases.terms[rows, order[:, 0]]
    at = np.minimum(np.searchsorted(term, rarest), len(term) - 1)
    rows = rows[term[at] == rarest]
    at = at[rows]
    n = high[at] - low[at]
    group = np.cumsum(n) // STARTS
    out = []
    for g in np.unique(group):
        mine = group == g
        which, place = _expanded(low[at[mine]], high[at[mine]])
        which = rows[mine][which]
        anchor = position[place].astype(np.int64)
        doc = np.searchsorted(first, anchor, "right") - 1
        begin, end = first[doc], first[doc + 1]
        start = anchor - order[which, 0] if slop is None else anchor
        if slop is None:
            ok = (start >= begin) & (start + phrases.length[which] <= end)
            which, start, begin, end = which[ok], start[ok], begin[ok], end[ok]
        for r in range(1, phrases.terms.shape[1]):
            if not len(which):
                break
            offset = order[which, r]
            wanted = phrases.terms[which, offset].astype(np.int64)
            lowest = start + offset if slop is None else np.maximum(start - slop, begin)
            highest = lowest if slop is None else np.minimum(start + slop, end - 1)
            i = np.minimum(np.searchsorted(keys, (wanted << 32) | lowest), len(keys) - 1)
            ok = (wanted < 0) | ((keys[i] >= (wanted << 32 | lowest)) & (keys[i] <= (wanted << 32 | highest)))
            which, start, begin, end = which[ok], start[ok], begin[ok], end[ok]
        out.append((which, start))
    return (np.concatenate([w for w, _ in out]), np.concatenate([s for _, s in out])) if out else none


def search(postings: DataFrame, phrases: Phrases, slop: int | None = None) -> DataFrame:
    """For every document of the index: where which items' phrases were found (MATCH_SCHEMA)."""
    order = rarest_first(phrases, document_frequencies(postings, len(phrases.vocabulary)))
    shared = postings.sparkSession.sparkContext.broadcast((phrases, order))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, order = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                def get(c, row=row, batch=batch):
                    return batch.column(c)[row]

                first = get("first").values.to_numpy()
                position = np.frombuffer(get("position").as_py(), np.int32)
                term, upto = get("term").values.to_numpy(), get("upto").values.to_numpy()
                which, start = matches(phrases, order, first, term, upto, position, slop)
                doc = np.searchsorted(first, start, "right") - 1
                by_doc = np.argsort(doc, kind="stable")
                which, start, doc = which[by_doc], start[by_doc], doc[by_doc]
                cut = np.searchsorted(doc, np.arange(len(first)))
                offsets = pa.array(cut, pa.int32())
                named = [sorted({x for w in set(which[a:b].tolist()) for x in phrases.items[w]}) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.record_batch(
                    {
                        "doc_id": get("doc_id").values,
                        "text_key": get("text_key").values,
                        "n_words": pa.array(np.diff(first), pa.int64()),
                        "start": pa.ListArray.from_arrays(offsets, pa.array(start - first[doc], pa.int32())),
                        "length": pa.ListArray.from_arrays(offsets, pa.array(phrases.length[which], pa.int32())),
                        "item": pa.array(named, pa.list_(pa.string())),
                    }
                )

    return in_batches(postings, find, MATCH_SCHEMA)


def judged(found: DataFrame) -> DataFrame:
    """Hit words, items and verdict of each document from its matches."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, n_items, digests = [], [], []
            starts, lengths, items = (batch.column(c) for c in ("start", "length", "item"))
            for i in range(batch.num_rows):
                start, length = starts[i].values.to_numpy(), lengths[i].values.to_numpy()
                order = np.argsort(start, kind="stable")
                end = np.maximum.accumulate((start + length)[order]) if len(start) else start
                start = start[order]
                before = np.r_[0, end[:-1]] if len(start) else start
                hits.append(int(np.maximum(end - np.maximum(start, before), 0).sum()))
                names = sorted(set(items[i].as_py()))
                n_items.append(len(names))
                digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            n_words, n_hit = batch.column("n_words").to_numpy(), np.array(hits, np.int64)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "text_key": batch.column("text_key"),
                    "n_words": batch.column("n_words"),
                    "n_hit": pa.array(n_hit),
                    "n_items": pa.array(n_items, pa.int64()),
                    "items_sha256": pa.array(digests, pa.string()),
                    "contaminated": pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                }
            )

    return in_batches(found, judge, RESULT_SCHEMA)


def verdicts(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """What ``decontaminate`` returns, and text_key.

    The benchmark comes to the driver in rounds of about ``round_bytes`` of text, one in all
    unless it is larger. Matches of several rounds are put together per document; documents
    of equal doc_id and text have equal matches, so one of them stands for all there.
    """
    items = staged(
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("NULL")).alias("item_id"), "text"), "items"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = 1 + total // round_bytes
    found = None
    for r in range(rounds):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r).collect()
        phrases = phrases_of([(x["item_id"], x["text"]) for x in mine], window)
        more = search(index(docs, phrases.vocabulary), phrases)
        found = more if found is None else found.unionByName(more)
    if rounds == 1:
        return judged(found)
    together = found.groupBy("doc_id", "text_key", "n_words").agg(
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("start", "length", "item")],
        (F.count(F.lit(1)) / rounds).cast("int").alias("rows"),
    )
    return judged(together.withColumn("row", F.explode(F.expr("sequence(1, rows)"))).drop("row", "rows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    return verdicts(docs, benchmark, **options).drop("text_key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all of their columns, that are not contaminated."""
    bad = verdicts(docs, benchmark, **options).where("contaminated").select(
        F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")
    )
    return docs.join(
        staged(bad.distinct(), "contaminated"),
        docs["doc_id"].eqNullSafe(F.col("bad_id")) & (text_key() == F.col("bad_key")),
        "left_anti",
    )


_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all({_LOWER}, '{_PATTERN}'), []) AS w
    FROM documents),
i AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), 'NULL') AS item_id,
           coalesce(regexp_extract_all({_LOWER}, '{_PATTERN}'), []) AS w
    FROM benchmark),
p AS (
    SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size,
           array_to_string(w[s : s + least(len(w), {WINDOW}) - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
g AS (
    SELECT n, s, size, array_to_string(w[s : s + size - 1], ' ') AS phrase
    FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS s
          FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)),
m AS (SELECT n, s, size, item_id FROM g JOIN p USING (size, phrase)),
h AS (SELECT n, count(DISTINCT pos) AS n_hit FROM (SELECT n, unnest(range(s, s + size)) AS pos FROM m) GROUP BY n),
t AS (
    SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
    FROM (SELECT DISTINCT n, item_id FROM m) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (n) LEFT JOIN t USING (n)
"""
