"""Stupid-backoff scores of documents from n-gram counts.

The score of a word after the ``order - 1`` words before it is count(n-gram) / count(all of
it but the last word), or, for an n-gram that was never counted, 0.4 times the score after
one word less, down to count(word) / words. A document's score is the sum of log10 over its
words. With ``leave_out``, counts are those of all other rows: what a document has of an
n-gram itself is taken off, so n-grams found nowhere else are backed off from.

The n-gram tables are partitioned by hash. Every slice of documents (some megabytes of text)
is a row, and sends one row to each partition with its distinct hashes there and how often
it has each. A partition adds the counts up to its part of the table, joins the hashes of
every slice to it and sends the counts back in the same order. They are joined to the slice,
whose documents are split into n-grams again and scored: which order a word is scored by
depends on counts from several partitions, so these meet at the document.

Whatever share of all n-grams one n-gram has, it is one entry per slice.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z made lower case; n-grams are 62-bit hashes.

Defined cases: NULL and empty texts have no words, score 0 and mean NULL; a word that was
never counted counts as one; repeated rows are scored each, and count as often as they
are there, with ``leave_out`` for each other; an empty table gives no rows; other columns
are not looked at. ``docs`` must be a table, or else come in the same order when a lost task
is run again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import _grouped
from .shared import in_batches, staged
from .words import NOT_SPACE, gram_starts, sequence_hashes, slices, split

BACKOFF = 0.4
#: Bytes of text of a slice: the larger, the fewer rows and repeated n-grams are sent.
SLICE = 4 << 20
#: Bytes of text whose n-grams make a partition of the tables.
PARTITION_BYTES = 8 << 20

#: How hard texts are compressed before they are moved, by zstd.
TEXT_LEVEL = 9

SLICE_SCHEMA = "slice bigint, docs binary"
MESSAGE_SCHEMA = "slice bigint, part int, asks boolean, keys binary, totals binary"
ANSWER_SCHEMA = "slice bigint, part int, counts binary"
SCORE_SCHEMA = "doc_id bigint, n_words bigint, n_single bigint, score double"

_ORDER_BITS = np.uint64(3)


def _zstd(data: bytes) -> bytes:
    """Compressed, after the length that it had."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzstd(data: pa.Buffer) -> pa.Buffer:
    return pa.decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little"), codec="zstd")


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences: as many low bytes as look random just so, the high ones, small numbers and 0, compressed.

    All in one would get one code for bytes that differ in kind.
    """
    gap = int(keys[-1] - keys[0]) // max(len(keys) - 1, 1) if len(keys) else 0
    low = min(gap.bit_length() // 8, 7)
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    high = pa.compress(planes[low:].tobytes(), codec="zstd", asbytes=True)
    return bytes([low]) + len(keys).to_bytes(8, "little") + planes[:low].tobytes() + high


def _unpacked(data: pa.Buffer) -> np.ndarray:
    head = data[:9].to_pybytes()
    low, n = head[0], int.from_bytes(head[1:], "little")
    high = pa.decompress(data[9 + low * n :], (8 - low) * n, codec="zstd")
    planes = np.concatenate([np.frombuffer(data, np.uint8, low * n, 9), np.frombuffer(high, np.uint8)]).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as hold them all, and before them how many bytes that is."""
    size = next(s for s in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * s - (s == 8)))
    return _zstd(bytes([size]) + np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes())


def _large(data: pa.Buffer) -> np.ndarray:
    data = np.frombuffer(_unzstd(data), np.uint8)
    planes = data[1:].reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(np.int64)


def ngrams(part: pa.RecordBatch, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The words of each document, and for each order up to that one the key of every n-gram and the place of its last word.

    The lowest two bits of a key are the order less one.
    """
    counts, keys, last, before = [], [[] for _ in range(order)], [[] for _ in range(order)], 0
    for piece in slices([part]):
        words = split(piece.column("text"), NOT_SPACE, lower=True)
        hashes = words.hashes() & ~_ORDER_BITS
        counts.append(words.count)
        for n in range(1, order + 1):
            at = gram_starts(words.first, n)
            key = sequence_hashes(hashes, at, at + n, 12) & ~_ORDER_BITS if n > 1 else hashes
            keys[n - 1].append(key | np.uint64(n - 1))
            last[n - 1].append(at + (before + n - 1))
        before += len(hashes)
    none = np.zeros(0, np.int64)
    return (
        np.concatenate([none, *counts]),
        [np.concatenate([none.astype(np.uint64), *x]) for x in keys],
        [np.concatenate([none, *x]).astype(np.int64) for x in last],
    )


def _cut(docs: DataFrame) -> DataFrame:
    """Each slice of the documents as one row, so that their order in it is settled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=TEXT_LEVEL))
        base = TaskContext.get().partitionId() << 28
        for nth, part in enumerate(slices(batches, limit=SLICE)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            body = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            yield pa.record_batch({"slice": pa.array([base + nth], pa.int64()), "docs": body})

    return in_batches(docs.select("doc_id", "text"), cut, SLICE_SCHEMA)


def _documents(cell: pa.Scalar) -> pa.RecordBatch:
    table = pa.ipc.open_stream(cell.as_buffer()).read_all()
    return table.combine_chunks().to_batches()[0]


def _messages(cut: DataFrame, parts: int, order: int, *, counted: bool, asks: bool) -> DataFrame:
    """The rows the slices send: to be counted, to ask for counts, or both."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, cell in zip(batch.column("slice").to_pylist(), batch.column("docs"), strict=True):
                key, total = np.unique(np.concatenate(ngrams(_documents(cell), order)[1]), return_counts=True)
                # The highest bits say which partition, so its keys are side by side.
                where = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                ends = np.searchsorted(where, np.arange(parts + 1))
                rows = np.flatnonzero(np.diff(ends)).tolist()
                ranges = [slice(ends[p], ends[p + 1]) for p in rows]
                yield pa.record_batch(
                    {
                        "slice": pa.array([number] * len(rows), pa.int64()),
                        "part": pa.array(rows, pa.int32()),
                        "asks": pa.array([asks] * len(rows), pa.bool_()),
                        "keys": pa.array([_packed(key[r]) for r in ranges], pa.binary()),
                        "totals": pa.array([_small(total[r]) if counted else None for r in ranges], pa.binary()),
                    }
                )

    return in_batches(cut, send, MESSAGE_SCHEMA)


def _answers(messages: DataFrame, parts: int) -> DataFrame:
    """For every slice that asks and every partition: the counts of the slice's n-grams there, in their order."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["part"]):
            part = group.column("part")[0].as_py()
            slice_of, asks = group.column("slice").to_pylist(), group.column("asks").to_pylist()
            keys = [_unpacked(x.as_buffer()) for x in group.column("keys")]
            totals = [_large(x.as_buffer()) if x.is_valid else np.zeros(len(k), np.int64) for x, k in zip(group.column("totals"), keys, strict=True)]
            del group
            ends = np.cumsum([len(k) for k in keys])
            table, at = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            # Whole numbers below 2^53 are exact as weights.
            count = np.bincount(at, np.concatenate(totals), len(table)).astype(np.int64)
            del table, totals
            mine = zip(slice_of, asks, [0, *ends[:-1]], ends, strict=True)
            out = [(who, _small(count[at[low:high]])) for who, asking, low, high in mine if asking]
            yield pa.record_batch(
                {
                    "slice": pa.array([who for who, _ in out], pa.int64()),
                    "part": pa.array([part] * len(out), pa.int32()),
                    "counts": pa.array([counts for _, counts in out], pa.binary()),
                }
            )

    return in_batches(messages.repartition(parts, "part").sortWithinPartitions("part", "slice"), answer, ANSWER_SCHEMA)


def _scores(part: pa.RecordBatch, count_of: np.ndarray, order: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document its words, those scored by their own count alone, and the sum of logarithms.

    ``count_of`` are the counts of the distinct n-grams by key. What is divided by the number
    of all words is not so divided here.
    """
    n_words, keys, last = ngrams(part, order)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    if len(distinct) != len(count_of):
        raise ValueError(f"{len(count_of)} counts for {len(distinct)} n-grams: the documents came in another order when read again")
    n_docs, n = len(n_words), int(n_words.sum())
    count, doc = count_of[at], np.repeat(np.arange(n_docs), n_words)
    if leave_out:
        whose = np.concatenate([doc[x] for x in last])
        whose *= max(len(distinct), 1)
        whose += at
        _, same, own = np.unique(whose, return_inverse=True, return_counts=True)
        del whose
        count -= own[same]
        del same, own
    del distinct, at
    counts = np.zeros((order + 1, n), np.int64)  # of the n-grams by their last word; of order 0 there are none
    for k, (ends, c) in enumerate(zip(last, np.split(count, np.cumsum([len(x) for x in last])[:-1]), strict=True), 1):
        counts[k, ends] = c
    # The order that a word is first tried by.
    tried = np.minimum(np.arange(n) - (np.cumsum(n_words) - n_words)[doc] + 1, order)
    log, still = np.zeros(n), np.ones(n, bool)
    for k in range(order, 1, -1):
        at = np.flatnonzero(still & (counts[k] > 0))
        log[at] = np.log10(counts[k, at]) - np.log10(counts[k - 1, at - 1]) + math.log10(BACKOFF) * (tried[at] - k)
        still[at] = False
    at = np.flatnonzero(still)
    log[at] = np.log10(np.maximum(counts[1, at], 1)) + math.log10(BACKOFF) * (tried[at] - 1)
    return n_words, np.bincount(doc[at], minlength=n_docs), np.bincount(doc, log, n_docs).astype(np.float64)


def _slices_together(cut: DataFrame, answers: DataFrame, parts: int, order: int, leave_out: bool) -> DataFrame:
    """The scores of every slice, from its documents and the counts from all partitions.

    ``cut`` is dealt by slice. The answers are dealt the same way, else the join would deal both anew.
    """

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, counts in zip(batch.column("docs"), batch.column("counts"), strict=True):
                part = _documents(docs)
                replies = [_large(x.as_buffer()) for x in counts.values] if counts.is_valid else []
                count = np.concatenate([np.zeros(0, np.int64), *replies])
                n_words, n_single, score = _scores(part, count, order, leave_out)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_words": pa.array(n_words, pa.int64()),
                        "n_single": pa.array(n_single, pa.int64()),
                        "score": pa.array(score),
                    }
                )

    replies = answers.repartition(parts, "slice").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("part", "counts"))).alias("replies"))
    rows = cut.join(replies, "slice", "left").select("docs", F.col("replies.counts").alias("counts"))
    return in_batches(rows, together, SCORE_SCHEMA)


def number_of_words(docs: DataFrame) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.record_batch({"n": pa.array([len(split(part.column("text"), NOT_SPACE, lower=True).start)], pa.int64())})

    return in_batches(docs.select("text"), count, "n bigint").agg(F.sum("n")).first()[0] or 0


def score(docs: DataFrame, counted: DataFrame | None = None, *, order: int = 2, leave_out: bool = False) -> DataFrame:
    """doc_id, n_words, score and mean of every document, by n-grams of up to ``order`` (2 to 4) words.

    Counts are those of ``counted``, or of the documents themselves; then no n-gram is missing,
    unless ``leave_out`` takes each document's own off.
    """
    if not 2 <= order <= 4:
        raise ValueError(f"order must be 2, 3 or 4, not {order}")
    if leave_out and counted is not None:
        raise ValueError("leave_out is for documents that are counted themselves")
    spark = docs.sparkSession
    of = docs if counted is None else counted
    size = of.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    # One exchange, used twice: by what is sent, and by what the answers are joined to.
    cut = _cut(docs).repartition(parts, "slice")
    messages = _messages(cut, parts, order, counted=counted is None, asks=True)
    if counted is not None:
        messages = messages.unionByName(_messages(_cut(counted), parts, order, counted=True, asks=False))
    rows = staged(_slices_together(cut, _answers(messages, parts), parts, order, leave_out), "scores")
    words = (rows.agg(F.sum("n_words")).first()[0] or 0) if counted is None else number_of_words(counted)
    among = F.greatest(F.lit(words) - (F.col("n_words") if leave_out else F.lit(0)), F.lit(1))
    total = F.col("score") - F.col("n_single") * F.log10(among)
    return rows.select(
        "doc_id", "n_words", total.alias("score"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean")
    )
