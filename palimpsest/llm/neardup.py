"""Near-duplicate documents by HyperMinHash, banding and exact confirmation.

A document's set is its distinct shingles of 4 words. Its sketch has 128 registers: the
low bits of a shingle's hash name a register, and the register keeps the smallest of the
remaining bits, compressed to its leading-zero count (6 bits) and the 10 bits after the
first one. Four registers are a band, 32 bands a document.

1. Documents of equal words are one text from here on.
2. Texts that share a band are candidates. Each is first compared with one text of the
   band only, so a band that much of the corpus shares gives one pair for each text in
   it: the text that shares most bands with others, which of a group of altered copies is
   the one that they were made from. Pairs of sets too unlike in size, and those whose Jaccard
   estimate, corrected for registers equal by chance, is more than 6 standard deviations
   below 0.8 are dropped, the others are confirmed on their full sets.
3. With that text of each band all is done. Bands whose other texts are of two or more
   components are compared in full: by size and estimate
   first, then by full sets, only between components, and a pair only in the first band it
   shares; a block of texts returns the links that join components, not all pairs. That is
   for bands of up to LIGHT texts. Many texts share a band by a passage that they have in
   common; of those the full sets are ordered by the number of texts that have a shingle, and
   only texts that share one of their n - 0.8 n + 1 rarest are compared, as two sets that
   are similar by 0.8 must. Shingles of the passage are not among these, so texts with
   words of their own meet nobody, and no square of them comes up.
4. Components of all links give the classes.

Full sets are moved as compressed texts, from which the tasks that compare them make them anew:
that is a third of the bytes of their hashes. Bands are made anew from the sketches.

A pair with a similarity of 0.8 shares no band with probability (1 - 0.8^4)^32 < 5e-8.
Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z made lower case; shingles are compared by
64-bit hashes.

Defined cases: a text of 1 to 3 words has one shingle, all of it; NULL and empty texts
have none and link with nothing; repeated rows and rows that share a doc_id are one
document for linking, and each gets its row; a row without doc_id links with nothing,
has component_id NULL and is kept; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components, joined
from .shared import in_batches, staged
from .words import NOT_SPACE, SLICE_BYTES, document_hashes, gram_starts, sequence_hashes, slices, split

SHINGLE = 4
SIMILARITY = 80  # in hundredths
REGISTERS = 128
BAND = 4
MANTISSA = 10
#: Texts of a band that are compared with each other just so.
LIGHT = 64
#: Texts of a band that are compared with each other in one piece.
BLOCK = 1024
#: Mean size of the sets of a full block; larger ones make more blocks.
BLOCK_SHINGLES = 1024
#: Ids that a broadcast may hold, 16 bytes each.
BROADCAST_IDS = 1 << 19
#: Passes over the documents, with a broadcast of ids each, before a shuffle moves all texts.
PASSES = 8
#: Rows of up to 64 bytes that a broadcast may hold.
BROADCAST_ROWS = 1 << 17
#: Of the rare shingles by which a text meets others, so many tell which pairs have met.
FIRSTS = 8
#: Standard deviations by which an estimate may fall short.
MARGIN = 6.0

_VALUE_BITS = 57
_EMPTY = np.uint16(0xFFFF)
_NO_BAND = np.uint64(0xFFFFFFFFFFFFFFFF)

SKETCH_SCHEMA = "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, sketch binary, bands array<bigint>"
SET_SCHEMA = "doc_id bigint, packed binary"
BAND_SCHEMA = "band bigint, doc_id bigint, n_shingles bigint"


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes by document and value, where each document's begin, and two keys of its words."""
    words = split(texts, NOT_SPACE, lower=True)
    hashes, count = words.hashes(), words.count
    low, high = words.first[:-1], words.first[1:]
    at = gram_starts(words.first, size)
    short = np.flatnonzero((count > 0) & (count < size))
    value = np.r_[sequence_hashes(hashes, at, at + size, 7), sequence_hashes(hashes, low[short], high[short], 7)]
    doc = np.r_[words.doc[at], short]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]
        value, doc = value[new], doc[new]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return value, first, document_hashes(hashes, words.first, 8), document_hashes(hashes, words.first, 9)


def compressed(least: np.ndarray) -> np.ndarray:
    """Registers from the smallest 57-bit values: leading zeros, then the bits after the first one."""
    exponent = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # bits in use; may round up to the next power
    exponent -= (least >> np.maximum(exponent - 1, 0).astype(np.uint64)) == 0
    zeros = np.minimum(_VALUE_BITS - exponent, 62).astype(np.uint64)
    shift = exponent - 1 - MANTISSA
    tail = np.where(
        shift >= 0, least >> np.maximum(shift, 0).astype(np.uint64), least << np.maximum(-shift, 0).astype(np.uint64)
    ) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros << np.uint64(MANTISSA)) | tail).astype(np.uint16)


def sketches(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The registers of each document, one row each."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    register = (value & np.uint64(REGISTERS - 1)).astype(np.int64)
    np.minimum.at(least, doc * REGISTERS + register, value >> np.uint64(64 - _VALUE_BITS))
    full = least != np.iinfo(np.uint64).max
    out = np.full(n * REGISTERS, _EMPTY)
    out[full] = compressed(least[full])
    return out.reshape(n, REGISTERS)


def band_keys(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and keys of all bands with a register in use."""
    n = len(registers)
    bands = np.ascontiguousarray(registers).view(np.uint64)
    number = np.arange(bands.shape[1], dtype=np.uint64)
    # Equal words and another band give another key.
    keys = sequence_hashes(
        np.stack([bands.ravel(), np.tile(number, n)], axis=1).ravel(), np.arange(bands.size) * 2, np.arange(bands.size) * 2 + 2, 10
    ).reshape(bands.shape)
    used = bands != _NO_BAND
    doc, band = np.nonzero(used)
    return doc, keys[doc, band]


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, and the number of registers they rest on.

    Of registers used by either, those that are equal count; expected are 0.17 of them for
    every 2^10 by chance, less for sets of unequal size.
    """
    used = ((a != _EMPTY) | (b != _EMPTY)).sum(-1)
    equal = ((a == b) & (a != _EMPTY)).sum(-1)
    chance = 0.169919 * 4.0 * n_a * n_b / np.maximum(n_a + n_b, 1) ** 2 / (1 << MANTISSA)
    return (equal / np.maximum(used, 1) - chance) / (1 - chance), used


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Whether an estimate, and the sizes of the sets, leave room for the similarity."""
    estimate, used = estimates(a, b, n_a, n_b)
    wanted = similarity / 100
    room = MARGIN * np.sqrt(wanted * (1 - wanted) / np.maximum(used, 1))
    fits = 100 * np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b)
    return fits & (estimate >= wanted - room)


def linked(a: np.ndarray, b: np.ndarray, similarity: int = SIMILARITY) -> bool:
    """Whether two full sets are as similar as that."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def sketched(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            value, first, k1, k2 = shingle_sets(part.column("text"))
            registers = sketches(value, first)
            doc, keys = band_keys(registers)
            offsets = np.searchsorted(doc, np.arange(part.num_rows + 1))
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "k1": pa.array(k1.view(np.int64)),
                    "k2": pa.array(k2.view(np.int64)),
                    "n_shingles": pa.array(np.diff(first), pa.int64()),
                    "sketch": pa.array([r.tobytes() for r in registers], pa.binary()),
                    "bands": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64))),
                }
            )

    return in_batches(docs.select("doc_id", "text"), scan, SKETCH_SCHEMA)


def banded(texts: DataFrame) -> DataFrame:
    """(band, doc_id, n_shingles): the bands of each text, from its sketch."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                doc, keys = band_keys(_registers(batch.column("sketch")))
                columns = {c: batch.column(c).take(pa.array(doc)) for c in ("doc_id", "n_shingles")}
                yield pa.record_batch({"band": pa.array(keys.view(np.int64)), **columns})

    return in_batches(texts.select("doc_id", "n_shingles", "sketch"), listed, BAND_SCHEMA)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The full sets of the documents named by the one column of ``ids``, each as its text, compressed.

    Up to BROADCAST_IDS of them go to all tasks at once, so that no text is moved but those of
    rows that share a doc_id, of which equal ones are one; more than PASSES times as many are
    joined with a shuffle.
    """
    named = docs.select("doc_id").join(ids.toDF("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi")
    ids = staged(named.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("held")), "ids")
    passes, several = -(-ids.count() // BROADCAST_IDS), not ids.where("held > 1").isEmpty()

    def of(wanted: DataFrame) -> DataFrame:
        return docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("id"), "left_semi")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("")
            packed = pa.array([zlib.compress(x.as_buffer()) for x in texts], pa.binary())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "packed": packed})

    def packed(some: DataFrame) -> DataFrame:
        needed = of(F.broadcast(some.where("held = 1")))
        if several:
            needed = needed.unionByName(of(F.broadcast(some.where("held > 1"))).distinct())
        return in_batches(needed, scan, SET_SCHEMA)

    if passes > PASSES:
        return in_batches(of(ids).distinct(), scan, SET_SCHEMA)
    if passes <= 1:
        return packed(ids)
    nth = F.pmod(F.xxhash64("id"), F.lit(passes))
    return reduce(DataFrame.unionByName, [staged(packed(ids.where(nth == i)), "sets") for i in range(passes)])


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows in their order, some at a time, with the shingles of their sets and where each set begins."""
    for some in slices(batches, "packed", SLICE_BYTES // 4):
        texts = pa.array([zlib.decompress(x.as_buffer()) for x in some.column("packed")], pa.large_binary())
        rows = some.drop_columns(["packed"]).append_column("text", texts.view(pa.large_string()))
        for part in slices([rows]):
            value, first, _, _ = shingle_sets(part.column("text"))
            yield part, value, first


def _small(rows: DataFrame) -> DataFrame:
    """The rows, written, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows with a key of ``wanted``, told where they are; all rows if those keys are very many."""
    ids = staged(wanted.select(key).distinct(), "ids")
    return rows.join(F.broadcast(ids), key, "left_semi") if ids.count() <= BROADCAST_IDS else rows


def _with(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows joined with ``wanted``, a written table; most rows have none there and are not moved."""
    few = wanted.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(wanted), key) if few else _only(rows, wanted, key).join(wanted, key)


def _near_in_size(a: str, b: str, similarity: int) -> str:
    """SQL: whether two sets of these sizes can be as similar as that."""
    return f"100 * least({a}, {b}) >= {similarity} * greatest({a}, {b})"


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _likely(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b), a written table, whose sketches leave room for the similarity."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _registers(batch.column("sketch_a")), _registers(batch.column("sketch_b"))
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            ok = pa.array(may_link(a, b, n_a, n_b, similarity))
            yield pa.record_batch({c: batch.column(c).filter(ok) for c in ("a", "b")})

    of = {
        c: texts.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n_shingles").alias(f"n_{c}"))
        for c in "ab"
    }
    both = _with(of["a"], pairs, "a").join(_only(of["b"], pairs, "b"), "b")
    return in_batches(both, keep, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, docs: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that are linked, by full sets.

    The set of b comes once for every 128 of its partners, then those one by one, so
    neither a pair carries two sets nor does a task hold more than two and a slice at a time.
    """
    per_b = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 128).alias("parts"))
    pairs = pairs.join(per_b, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    others = pairs.select(F.col("a").alias("doc_id"), "b", "part", "a")
    heads = pairs.select(F.col("b").alias("doc_id"), "b", "part", F.lit(None).cast("bigint").alias("a")).distinct()
    places = staged(others.unionByName(heads), "places")
    rows = full_sets(docs, places.select("doc_id")).join(_small(places), "doc_id").select("b", "part", "a", "packed")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch, value, first in unpacked(batches):
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("b", "part", "a")), strict=True)
            for (b, part, a), low, high in zip(keys, first[:-1], first[1:], strict=True):
                data = value[low:high]
                if (b, part) != now:
                    now, own = (b, part), []
                if a is None:
                    own.append(data.copy())
                elif any(linked(x, data, similarity) for x in own):
                    out.append((a, b))
            yield pa.record_batch({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return in_batches(rows, compare, "a bigint, b bigint")


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, which come one after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if held and rows[low] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = rows[low]
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(
    group: pa.Table, registers: np.ndarray, n: np.ndarray, similarity: int, first_only: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Of a block, which of its rows are likely to be linked across components: a matrix's places.

    Texts of different components share open bands only, so with ``first_only`` each pair is met in its
    first one, or, where only the first part of the sketches is there, in the first of those and in later ones.
    Pairs that share one of their ``firsts``, if rows have them, are met in the smallest such band.
    """
    bands, band = registers.view(np.uint64), group.column("band")[0].as_py()
    here = np.nonzero(bands != _NO_BAND)[1][band_keys(registers)[1].view(np.int64) == band]
    now = here[0] if len(here) else bands.shape[1]
    label, block = (group.column(c).to_numpy() for c in ("component", "own"))
    crossing = group.column("i")[0].as_py() != group.column("j")[0].as_py()
    firsts = None
    if "firsts" in group.column_names:
        lists = group.column("firsts").to_pylist()
        # Places beyond the end of a list are equal to none.
        firsts = np.array([x + [band] * (FIRSTS - len(x)) for x in lists], np.int64)
    left, right = [], []
    for x in range(len(n) - 1):
        y = np.arange(x + 1, len(n))
        y = y[(label[y] != label[x]) & ((block[y] != block[x]) if crossing else True)]
        if first_only:
            earlier = (bands[y, :now] == bands[x, :now]) & (bands[x, :now] != _NO_BAND)
            y = y[~earlier.any(axis=1)]
        if len(y):
            y = y[may_link(registers[x][None, :], registers[y], np.full(len(y), n[x]), n[y], similarity)]
        if len(y) and firsts is not None:
            own = firsts[x][firsts[x] < band]
            y = y[~(firsts[y][:, :, None] == own).any(axis=(1, 2))]
        if len(y):
            left.append(np.full(len(y), x))
            right.append(y)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _open(named: DataFrame) -> DataFrame:
    """Bands that hold texts of several components: how many texts, and of how many shingles together."""
    held = named.groupBy("band").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.count(F.lit(1)).alias("held"),
        F.sum("n_shingles").alias("size"),
    )
    return held.where("low <> high").select("band", "held", "size")


def _sized(members: DataFrame, similarity: int) -> DataFrame:
    """Of small bands, the members of which another, of another component, is near in size."""
    row = F.struct("doc_id", "n_shingles", "component")
    of_band = members.groupBy("band", "held", "size").agg(F.collect_list(row).alias("row"))
    near = f"y.component <> x.component AND {_near_in_size('x.n_shingles', 'y.n_shingles', similarity)}"
    return of_band.select("band", "held", "size", F.expr(f"inline(filter(row, x -> exists(row, y -> {near})))"))


def _different(members: DataFrame) -> DataFrame:
    """Of bands that hold the same texts, the one with the smallest key, with all its members.

    Texts that have a passage in common share each of its shingles, and are compared once for all
    of them. Members are told by their number and two sums of hashes.
    """
    same = members.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("doc_id", "n_shingles")).alias("x1"),
        F.bit_xor(F.xxhash64("n_shingles", "doc_id")).alias("x2"),
    )
    one = same.groupBy("n", "x1", "x2").agg(F.min("band").alias("band")).select("band")
    return members.join(one, "band")


def rarest(docs: DataFrame, ids: DataFrame, similarity: int) -> DataFrame:
    """(band, doc_id, n_shingles): the rarest shingles of each set, of which two sets that alike share one.

    Shingles that only one of these documents has come first and bring nobody together, so
    they are counted, not kept.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, value, first in unpacked(batches):
            bands = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.view(np.int64)))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_shingles": pa.array(np.diff(first), pa.int64()), "bands": bands})

    rows = in_batches(full_sets(docs, ids), listed, "doc_id bigint, n_shingles bigint, bands array<bigint>")
    # Documents may share an id, so a set goes by its content too.
    rows = staged(rows.withColumn("own", F.xxhash64("bands")), "sets")
    each = rows.select("doc_id", "n_shingles", "own", F.explode("bands").alias("band"))
    shared = staged(each.groupBy("band").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "shared")
    met = each.join(shared, "band")
    of_set = Window.partitionBy("doc_id", "own")
    nth = F.row_number().over(of_set.orderBy("held", "band")) + F.col("n_shingles") - F.count(F.lit(1)).over(of_set)
    needed = F.col("n_shingles") - F.ceil(F.col("n_shingles") * similarity / 100) + 1
    return met.withColumn("nth", nth).where(F.col("nth") <= needed).select("band", "doc_id", "n_shingles")


def _rest(
    bands: DataFrame, labels: DataFrame, texts: DataFrame, docs: DataFrame, similarity: int, block: int
) -> DataFrame:
    """Links between components found so far, from the bands that hold texts of several."""
    component = F.coalesce("component", "doc_id").alias("component")
    labels = labels.withColumnRenamed("id", "doc_id")

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "doc_id", "left").select("band", "doc_id", "n_shingles", component)

    bands = staged(named(bands), "named")
    members = staged(bands.join(_open(bands), "band"), "open")
    light = _sized(members.where(F.col("held") <= LIGHT), similarity)
    links = _between(light, texts, docs, similarity, block, first_only=True)
    heavy = staged(members.where(F.col("held") > LIGHT).select("doc_id").distinct(), "heavy")
    if heavy.isEmpty():
        return links
    few = staged(named(rarest(docs, heavy, similarity)), "rarest")
    few = staged(_different(staged(few.join(_open(few), "band"), "open")), "open")
    firsts = F.slice(F.array_sort(F.collect_set("band")), 1, FIRSTS).alias("firsts")
    few = few.join(few.groupBy("doc_id").agg(firsts), "doc_id")
    return links.unionByName(_between(few, texts, docs, similarity, block, first_only=False))


def _between(
    members: DataFrame, texts: DataFrame, docs: DataFrame, similarity: int, block: int, *, first_only: bool
) -> DataFrame:
    """Links between components, from bands with all their members; bands of many members are cut into blocks."""
    by_rows, by_size = F.ceil(F.col("held") / block), F.ceil(F.col("size") / (block * BLOCK_SHINGLES))
    members = members.withColumn("blocks", F.greatest(by_rows, by_size).cast("int"))
    key, extra = ["band", "i", "j"], [c for c in members.columns if c == "firsts"]
    members = (
        members.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component", *extra)
    )
    members = staged(members, "open")
    columns = members.columns

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, key):
            registers = _registers(group.column("sketch").combine_chunks())
            left, right = _open_pairs(group, registers, group.column("n_shingles").to_numpy(), similarity, first_only)
            rows = np.unique(np.r_[left, right])
            # A document may have several texts.
            rows = rows[np.unique(group.column("doc_id").to_numpy()[rows], return_index=True)[1]]
            yield from group.select(columns).take(rows).to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, key):
            sets_of, registers = [], []
            for _, value, first in unpacked(group.to_batches()):
                sets_of += [value[low:high] for low, high in zip(first[:-1], first[1:], strict=True)]
                registers.append(sketches(value, first))
            n = np.array([len(x) for x in sets_of])
            left, right = _open_pairs(group, np.concatenate(registers), n, similarity, first_only)
            ids = group.column("doc_id").to_pylist()
            parent = {c: c for c in group.column("component").to_pylist()}
            label = group.column("component").to_pylist()

            def root(c, parent=parent):
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            found = []
            for x, y in zip(left.tolist(), right.tolist(), strict=True):
                a, b = root(label[x]), root(label[y])
                if a != b and linked(sets_of[x], sets_of[y], similarity):
                    parent[max(a, b)] = min(a, b)
                    found.append((ids[x], ids[y]))
            yield pa.record_batch({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*key).sortWithinPartitions(*key, "doc_id")

    def compared(members: DataFrame, sketch: Column) -> DataFrame:
        rows = _with(texts.select("doc_id", "n_shingles", sketch.alias("sketch")), members, "doc_id")
        return staged(in_batches(dealt(rows.select(*columns, "n_shingles", "sketch")), near, members.schema), "open")

    if first_only:
        # Half a sketch settles most of it: bands that many texts share by a passage hold few that are alike.
        members = compared(members, F.substring("sketch", 1, REGISTERS))
    # Of what is left whole sketches are compared before sets are moved.
    members = compared(members, F.col("sketch")).drop("firsts")
    sets = full_sets(docs, members.select("doc_id"))
    rows = sets.join(_small(members), "doc_id").select(*members.columns, "packed")
    return in_batches(dealt(rows), link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = staged(sketched(docs).drop("bands"), "sketches")
    key = ["k1", "k2"]
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    texts = staged(
        known.groupBy(*key).agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
        ),
        "distinct",
    )
    copies = known.select(*key, F.col("doc_id").alias("a")).join(texts.select(*key, F.col("doc_id").alias("b")), key)
    copies = copies.where("a <> b").select("a", "b").distinct()

    bands = banded(texts)
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bands = staged(bands.join(shared, "band"), "bands")
    company = bands.groupBy("doc_id").agg(F.sum("n").alias("company"))
    place = F.struct("company", (-F.col("doc_id")).alias("id"), "n_shingles")
    centres = bands.join(company, "doc_id").groupBy("band").agg(F.max(place).alias("centre"))
    centres = staged(centres.select("band", (-F.col("centre.id")).alias("b"), F.col("centre.n_shingles").alias("n_b")), "centres")
    bands = staged(bands.join(centres, "band"), "bands")
    pairs = bands.where("doc_id <> b").where(_near_in_size("n_shingles", "n_b", similarity))
    pairs = staged(pairs.select(F.col("doc_id").alias("a"), "b").distinct(), "pairs")
    pairs = staged(_likely(pairs, texts, similarity), "pairs")

    links = staged(copies.unionByName(_confirmed(pairs, docs, similarity)), "links")
    labels = components(links)
    # The centre of a band has been compared with all of it.
    others = bands.where("doc_id <> b OR n_shingles <> n_b").select("band", "doc_id", "n_shingles")
    more = staged(_rest(others, labels, texts, docs, similarity, block), "links")
    if not more.isEmpty():
        labels = joined(labels, more)
    return (
        rows.select("doc_id", "n_shingles")
        .join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
        )
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, all of its columns: the one with the smallest doc_id.

    Rows equal in doc_id and text are one document; rows that share a doc_id only are as many as they have texts.
    """
    known, text = docs.where("doc_id IS NOT NULL"), F.coalesce(F.sha2("text", 256), F.lit("none"))
    several = known.groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low <> high")
    if several.isEmpty():
        kept = near_duplicates(docs, **options).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id"))
        kept = staged(kept.distinct(), "kept")
        chosen = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id"])
    else:
        chosen = _one_of_each_text(known, text, **options)
    return chosen.unionByName(docs.where("doc_id IS NULL"))


def _one_of_each_text(docs: DataFrame, text: Column, **options) -> DataFrame:
    """The same where texts share a doc_id: each text of a doc_id gets a number, and those are linked."""
    ids = docs.select(F.col("doc_id").alias("of"), text.alias("key")).distinct()
    ids = staged(ids.withColumn("number", F.monotonically_increasing_id()), "numbers")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("doc_id").alias("of"), text.alias("key"))
    rows = staged(whole.dropDuplicates(["of", "key"]).join(ids, ["of", "key"]), "numbered")
    found = near_duplicates(rows.select(F.col("number").alias("doc_id"), "document.text"), **options)
    found = found.select(F.col("doc_id").alias("number"), "component_id").join(ids, "number")
    least = found.groupBy("component_id").agg(F.min(F.struct("of", "key", "number")).alias("least"))
    kept = staged(least.select(F.col("least.number").alias("number")), "kept")
    return rows.join(kept, "number", "left_semi").select("document.*")


SQL = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
    SELECT x.a, x.b
    FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n_both
          FROM s p JOIN s q ON p.shingle = q.shingle AND p.doc_id <> q.doc_id GROUP BY ALL) x
    JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b
    WHERE 100 * n_both >= {SIMILARITY} * (na.n + nb.n - n_both)),
c AS (
    SELECT doc_id AS a, doc_id AS b FROM d
    UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a) m USING (doc_id)
"""
