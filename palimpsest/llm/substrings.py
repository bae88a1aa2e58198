"""Substring dedup by hashes of windows of words, partitioned by prefix.

A word is removed when a window of 35 words that covers it has the same words as a
window that starts anywhere else. In a suffix tree of all texts such a window would be an
internal node at a depth of 35 words or more with at least two leaves below it; no tree is
built here, as equal windows are found by their hashes. Nodes below that depth would remove
the same words, and maximal repeats are not returned.

1. Documents of equal words are one text, with the number of its copies. Copies of at
   least a window are removed whole; of each text one copy goes on.
2. Most suffixes are leaves high up in the tree, and never become part of it: of each
   window the smallest hash of 8 consecutive words is taken. Equal windows have equal
   ones, so a window whose smallest hash is nowhere else in the corpus is not repeated.
3. The suffixes left are split by their prefix, 8 words long, or 20 where so many
   suffixes share 8 words that their subtree would not fit in memory. Equal paths of 35
   words are counted before they are moved, so a passage that much of the corpus shares
   is one path. A task sorts the hashes of its prefixes' paths, and returns the paths
   with two leaves or more.
4. Suffixes at such nodes are joined back to their texts, whose words are then cut.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Paths are compared by hashes of 96 bits.

Defined cases: NULL and empty texts have no words and keep none; texts shorter than a
window keep all; repeated rows are copies of each other; rows of one doc_id and different
texts are judged each by its text; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, staged
from .words import NOT_SPACE, Words, document_hashes, gram_starts, sequence_hashes, slices, split

WINDOW = 35
#: Paths of a subtree that is built in one piece; a prefix with more of them is made longer.
GROUP_PATHS = 1 << 18
#: Paths of a task.
TASK_PATHS = 1 << 21

NOTHING_KEPT = hashlib.sha256(b"").hexdigest()

TEXT_SCHEMA = "doc_id bigint, text_hash bigint, k1 bigint, k2 bigint, n_words bigint, sha256 string, anchors array<bigint>"
SUFFIX_SCHEMA = "k1 bigint, k2 bigint, start array<int>, p array<int>, q array<int>, r array<bigint>"
CUT_SCHEMA = "k1 bigint, k2 bigint, n_removed bigint, kept_sha256 string"


def _lengths(window: int) -> tuple[int, int]:
    """Words of a short prefix, and of a long one."""
    return max(1, window * 8 // 35), max(1, window * 20 // 35)


def _sliding(values: np.ndarray, size: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best(values[i : i + size]) for every i; what lies beyond the end is the fill."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        shifted = np.full_like(out, fill)
        shifted[: len(out) - step] = out[step:]
        out, have = best(out, shifted), have + step
    return out


def window_anchors(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, the smallest short-prefix hash in each, and all such hashes by word (0: none)."""
    size = _lengths(window)[0]
    span = window - size + 1
    n = len(hashes)
    grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    at = gram_starts(first, size)
    grams[at] = sequence_hashes(hashes, at, at + size) | np.uint64(1)
    starts = gram_starts(first, window)
    least = _sliding(grams, span, np.minimum, np.iinfo(np.uint64).max)[starts]
    # A word's hash is smallest in some window when the largest of the windows' smallest over it equals it.
    of_window = np.zeros(n, np.uint64)
    of_window[starts] = least
    reach = _sliding(of_window[::-1], span, np.maximum, 0)[::-1]
    return starts, least, np.where(reach == grams, grams, np.uint64(0))


def _text_keys(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (
        document_hashes(hashes, words.first, 1).view(np.int64),
        document_hashes(hashes, words.first, 2).view(np.int64),
    )


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values, kind))


def _digests(words: Words, keep: np.ndarray | None = None) -> list[str]:
    data, bound = words.bytes_of(keep)
    data = memoryview(data)
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def texts(docs: DataFrame, window: int) -> DataFrame:
    """For every document: keys of its words, their number, their digest, and its anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = split(part.column("text"), NOT_SPACE, lower=False)
            hashes = words.hashes()
            k1, k2 = _text_keys(words, hashes)
            _, _, anchors = window_anchors(hashes, words.first, window)
            doc = words.doc[anchors > 0]
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "text_hash": part.column("text_hash"),
                    "k1": pa.array(k1),
                    "k2": pa.array(k2),
                    "n_words": pa.array(words.count, pa.int64()),
                    "sha256": pa.array(_digests(words), pa.string()),
                    "anchors": _lists(
                        np.bincount(doc, minlength=part.num_rows), anchors[anchors > 0].view(np.int64), pa.int64()
                    ),
                }
            )

    return in_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), scan, TEXT_SCHEMA)


def suffixes(candidates: DataFrame, window: int) -> DataFrame:
    """For each text the windows that have an anchor which occurs elsewhere: start and path.

    A path is the hashes of the short prefix, of the long prefix and of the whole window.
    """
    short, long = _lengths(window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = split(part.column("text"), NOT_SPACE, lower=False)
            hashes = words.hashes()
            starts, least, _ = window_anchors(hashes, words.first, window)
            repeated = part.column("anchors").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = starts[np.isin(least, repeated)]
            doc = words.doc[at]
            counts = np.bincount(doc, minlength=part.num_rows)

            def narrow(end: int, seed: int, at=at, hashes=hashes) -> np.ndarray:
                return (sequence_hashes(hashes, at, at + end, seed) >> np.uint64(33)).astype(np.int32)

            yield pa.record_batch(
                {
                    "k1": part.column("k1"),
                    "k2": part.column("k2"),
                    "start": _lists(counts, (at - words.first[doc]).astype(np.int32), pa.int32()),
                    "p": _lists(counts, narrow(short, 3), pa.int32()),
                    "q": _lists(counts, narrow(long, 4), pa.int32()),
                    "r": _lists(counts, sequence_hashes(hashes, at, at + window, 5).view(np.int64), pa.int64()),
                }
            )

    rows = in_batches(candidates, scan, SUFFIX_SCHEMA)
    return rows.select("k1", "k2", F.inline(F.arrays_zip("start", "p", "q", "r")))


def deep_nodes(paths: DataFrame, group_paths: int = GROUP_PATHS, task_paths: int = TASK_PATHS) -> DataFrame:
    """Of the distinct paths (p, q, r, leaves) those that are internal nodes at the depth of a window.

    ``paths`` is a written table. Prefixes with more than ``group_paths`` paths are as many
    as paths / group_paths at most, so their list can be broadcast.
    """
    spark = paths.sparkSession
    total = paths.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_paths))
    heavy = paths.groupBy("p").count().where(F.col("count") > group_paths).select("p", F.lit(True).alias("heavy"))
    grouped = paths.join(F.broadcast(heavy), "p", "left").repartition(
        tasks, "p", F.when(F.col("heavy"), F.col("q")).otherwise(F.lit(0))
    )

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        p, q, r, leaves = (table.column(c).to_numpy() for c in ("p", "q", "r", "leaves"))
        order = np.lexsort((r, q, p))  # depth first: children of a node are side by side
        p, q, r, leaves = p[order], q[order], r[order], leaves[order]
        same = np.r_[False, (p[1:] == p[:-1]) & (q[1:] == q[:-1]) & (r[1:] == r[:-1])]
        node = np.flatnonzero(~same)  # where the common prefix of neighbours is shorter than a window
        below = np.add.reduceat(leaves, node)
        deep = node[below >= 2]
        yield pa.record_batch({"q": pa.array(q[deep], pa.int32()), "r": pa.array(r[deep], pa.int64())})

    return in_batches(grouped.select("p", "q", "r", "leaves"), subtrees, "q int, r bigint")


def _cut(found: DataFrame, window: int) -> DataFrame:
    """Number of words removed from each text, and digest of the words kept."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = split(part.column("text"), NOT_SPACE, lower=False)
            starts = part.column("starts")
            change = np.zeros(len(words.start) + 1, np.int64)
            at = starts.flatten().to_numpy().astype(np.int64) + np.repeat(
                words.first[:-1], starts.value_lengths().to_numpy()
            )
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            gone = np.cumsum(change[:-1]) > 0
            yield pa.record_batch(
                {
                    "k1": part.column("k1"),
                    "k2": part.column("k2"),
                    "n_removed": pa.array(np.bincount(words.doc[gone], minlength=part.num_rows), pa.int64()),
                    "kept_sha256": pa.array(_digests(words, ~gone), pa.string()),
                }
            )

    return in_batches(found, cut, CUT_SCHEMA)


def remove_repeats(
    docs: DataFrame, *, window: int = WINDOW, group_paths: int = GROUP_PATHS, task_paths: int = TASK_PATHS
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    key = ["k1", "k2"]
    rows = staged(texts(docs, window), "texts")
    # Rows may share a doc_id, so it takes the hash of the text too to name one of them.
    one, name = F.min(F.struct("doc_id", "text_hash")), ("one_of", "one_text")
    classes = rows.groupBy(*key).agg(
        one.alias("one"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words")
    )
    classes = classes.select(*key, *[F.col("one")[i].alias(n) for i, n in zip(("doc_id", "text_hash"), name, strict=True)], "copies", "n_words")
    classes = staged(classes.where(F.col("n_words") >= window), "classes")
    same = [*(rows[k] == classes[k] for k in key), rows["doc_id"].eqNullSafe(classes["one_of"]), rows["text_hash"] == classes["one_text"]]
    one_each = rows.select("doc_id", "text_hash", *key, "anchors").join(classes.select(*key, *name, "copies"), same).select(
        "doc_id", "text_hash", rows["k1"], rows["k2"], "copies", F.explode("anchors").alias("anchor")
    )
    one_each = staged(one_each, "anchors")
    # A table of its own, so that the join below has two plain sides and a hot anchor can be split.
    repeated = staged(one_each.groupBy("anchor").count().where("count > 1").select("anchor"), "repeated")
    wanted = (
        one_each.join(repeated, "anchor", "left_semi")
        .groupBy("doc_id", "text_hash", *key, "copies")
        .agg(F.collect_set("anchor").alias("anchors"))
    )
    # Rows of the same doc_id and other words are told apart by the keys of their words.
    text = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    named = (wanted["text_hash"] == text["hash"]) & wanted["doc_id"].eqNullSafe(text["id"])
    candidates = wanted.join(text, named).select(*key, "copies", "anchors", "text")
    candidates = staged(_of_these_words(candidates), "candidates")

    leaves = suffixes(candidates.select(*key, "anchors", "text"), window)
    paths = staged(leaves.groupBy("p", "q", "r").agg(F.count(F.lit(1)).alias("leaves")), "paths")
    deep = deep_nodes(paths, group_paths, task_paths)
    starts = (
        leaves.select(*key, "start", "q", "r")
        .join(deep, ["q", "r"], "left_semi")
        .groupBy(*key)
        .agg(F.collect_list("start").alias("starts"))
    )
    single = candidates.where("copies = 1").select(*key, "text").dropDuplicates(key)
    cut = _cut(single.join(starts, key).select(*key, "text", "starts"), window)
    whole = classes.where("copies > 1").select(
        *key, F.col("n_words").alias("n_removed"), F.lit(NOTHING_KEPT).alias("kept_sha256")
    )
    result = staged(cut.unionByName(whole), "cut")
    return rows.join(result, key, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def _of_these_words(candidates: DataFrame) -> DataFrame:
    """The rows whose text has the words its keys say."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = split(part.column("text"), NOT_SPACE, lower=False)
            k1, k2 = _text_keys(words, words.hashes())
            same = (part.column("k1").to_numpy() == k1) & (part.column("k2").to_numpy() == k2)
            yield part if same.all() else part.filter(pa.array(same))

    schema = "k1 bigint, k2 bigint, copies bigint, anchors array<bigint>, text string"
    return in_batches(candidates, check, schema)


SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents),
s AS (
    SELECT n, s, array_to_string(w[s : s + {WINDOW - 1}], ' ') AS words
    FROM (SELECT n, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT words FROM s GROUP BY words HAVING count(*) > 1),
g AS (SELECT DISTINCT n, unnest(range(s, s + {WINDOW})) AS pos FROM s SEMI JOIN r USING (words)),
k AS (
    SELECT n, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE g.pos IS NULL) AS kept
    FROM (SELECT n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) LEFT JOIN g USING (n, pos)
    GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (n)
"""
