"""Words, n-grams and their hashes over Arrow batches of text, a few megabytes at a time.

Everything here works on the bytes of a slice of a batch at once, so a word costs a
few array operations and no Python object. Slices hold whole documents: texts are
never cut, and a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; bounds the arrays of a task whatever the size of its batches.
SLICE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of `[^\x20\x09-\x0D]+`: all but ASCII white space.
NOT_SPACE = ~_byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z: digits, letters, and all beyond ASCII.
ALNUM = ~_byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: ASCII letters and all beyond ASCII.
LETTER = _byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that all of their bits depend on all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    return mixed((a * _BASE) ^ (b * _STEP + _BASE))


#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def _byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each range, eight bytes after the other."""
    length = ends - starts
    out = mixed(length.astype(np.uint64) * _STEP)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        digest = hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    going, at = np.flatnonzero(length <= LONG_WORD), 0
    while len(going):
        left = np.minimum(length[going] - at, 8).astype(np.uint64)
        some = left > 0
        going, left = going[some], left[some]
        eight = eights[starts[going] + at] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))
        out[going] = _pair(out[going], eight)
        at += 8
        going = going[length[going] > at]
    return out


@dataclass
class Words:
    """The words of a slice: where each starts and ends in the bytes, and which words are whose."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each document, its first word; one more entry for the end

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """A hash of each word; of words of up to eight bytes no two have the same length and hash."""
        return _byte_hashes(self.data, self.start, self.end)

    def bytes_of(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each document joined by one space: bytes, and where each document's begin and end."""
        keep = np.ones(len(self.start), bool) if keep is None else keep
        start, end, doc = self.start[keep], self.end[keep], self.doc[keep]
        n_docs = len(self.first) - 1
        last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
        length = end - start
        take = length + ~last  # a space follows all but the last
        at = np.r_[0, np.cumsum(take)]
        out = np.full(at[-1], 0x20, np.uint8)
        within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(at[:-1], length) + within] = self.data[np.repeat(start, length) + within]
        size = np.bincount(doc, weights=take, minlength=n_docs).astype(np.int64)
        return out, np.r_[0, np.cumsum(size)]


def split(texts: pa.Array, word_bytes: np.ndarray, lower: bool) -> Words:
    """Words of each text: maximal runs of the given bytes. NULL has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(1, np.int64))
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    offsets = offsets - low
    data = _LOWER[data] if lower else data
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word_bytes[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.r_[False, inside[:-1]]
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, first)


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the word sequence of each range of words, equal ones wherever they lie. Seeds give independent hashes.

    Hashes of 1, 2, 4, ... words are made of pairs of those before; a range is the two of the
    largest such size that cover it, and its length. Time grows with the logarithm of the
    longest range; for whole documents there is ``document_hashes``.
    """
    starts, ends = np.asarray(starts), np.asarray(ends)
    length = ends - starts
    longest = int(length.max(initial=0))
    out = mixed(np.full(len(length), np.uint64((seed + 1) * int(_STEP) % (1 << 64))))
    level, size = mixed(hashes + np.uint64((seed * int(_STEP)) % (1 << 64))), 1
    while size <= longest:
        here = np.flatnonzero((length >= size) & (length < 2 * size))
        if len(here):
            two = _pair(level[starts[here]], level[ends[here] - size])
            out[here] = mixed(two + length[here].astype(np.uint64) * _STEP)
        if 2 * size <= longest:
            level = _pair(level[:-size], level[size:])
        size *= 2
    return out


def document_hashes(hashes: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of all words of each document: the sum of what each word and its place give."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = (np.arange(len(hashes)) - first[:-1][doc]).astype(np.uint64)
    each = _pair(hashes + np.uint64((seed + 1) * int(_BASE) % (1 << 64)), place)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(each, out=total[1:])
    return mixed(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64) * _STEP)


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """The positions at which n consecutive words of one document start."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    return np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut between rows into slices of a bounded number of bytes of text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.r_[0, np.cumsum(sizes.astype(np.int64))]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
