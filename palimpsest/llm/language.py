"""Language identification by a linear-chain conditional random field over words.

Every word gets a label. Its features are itself (the lexicon), its first and last one to
three bytes, and its byte trigrams, hashed into one table of weights per language;
weights between the labels of neighbouring words are learned too. Forward-backward gives
the probability of every label at every word, so text that changes language is labelled
piece by piece; a document's language is the one with the largest sum of probabilities,
and the score is its share of the words.

Words are runs of letters (ASCII letters and everything beyond ASCII), lower case. Whole
texts are labelled; a chain is 64 words, the next ones start a new chain.

The model is fitted on the driver on a bounded sample: about FIT_DOCS documents of each
language, FIT_CHARS characters of each at a place taken from its doc_id. Only documents
whose crc32 of doc_id modulo 5 is not 0, with a language, are learned from. The sample is
cut into pieces of some words, which are shuffled and joined, so that chains change
language as code-switched text does.

Defined cases: a NULL text, or one without a letter, is `und` with score 0, and so is
everything when there is nothing to learn from; equal scores go to the language that is
first in order of code points; repeated rows get equal rows; other columns are not looked
at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_batches
from .words import LETTER, Words, mixed, slices, split

UNKNOWN = "und"
CHAIN = 64
AFFIX = 3
TABLE_BITS = 17
FIT_DOCS = 300
FIT_CHARS = 1500
EPOCHS = 4
BATCH_WORDS = 1 << 12
SEED = 11

LABEL_SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, n_words bigint, n_switches bigint"
RUN_SCHEMA = "doc_id bigint, first_word bigint, n_words bigint, lang string, score double"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # table places x labels
    transitions: np.ndarray  # label before x label after


def held_out(doc_id: str = "doc_id") -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def lowered(texts: pa.Array) -> Words:
    return split(pc.utf8_lower(texts), LETTER, lower=False)


def features(words: Words, bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table, and the word each belongs to."""
    data, start, end = words.data.astype(np.uint64), words.start, words.end
    length, word = end - start, np.arange(len(start))
    out = [(words.hashes(), word)]
    for n in range(1, AFFIX + 1):
        has = word[length >= n]
        for tag, at in ((n, start[has]), (AFFIX + n, end[has] - n)):
            key = np.full(len(has), tag, np.uint64)
            for i in range(n):
                key = (key << np.uint64(8)) | data[at + i]
            out.append((mixed(key), has))
    grams = np.maximum(length - 2, 0)
    owner = np.repeat(word, grams)
    at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
    key = (data[at] << np.uint64(16)) | (data[at + 1] << np.uint64(8)) | data[at + 2] | np.uint64(1 << 40)
    out.append((mixed(key), owner))
    places = np.concatenate([h for h, _ in out]) >> np.uint64(64 - bits)
    return places.astype(np.int64), np.concatenate([w for _, w in out])


def _summed(values: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(word, values[:, k], n) for k in range(values.shape[1])], axis=1)


def chains(first: np.ndarray, size: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the chains of each document, the longest chains first."""
    count = np.diff(first)
    n = -(-count // size)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(first[:-1], n) + nth * size
    length = np.minimum(np.repeat(first[1:], n) - start, size)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order]


def marginals(
    emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, length: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and the expected number of each pair of neighbouring labels.

    Forward-backward over all chains at once, step by step, with every step scaled to sum
    1. Chains come longest first, so those still going are a prefix.
    """
    n, k = emissions.shape
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)) if n else emissions
    a = np.exp(transitions)
    going = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    forward, backward = np.zeros((n, k)), np.ones((n, k))
    for t, c in enumerate(going):
        at = start[:c] + t
        now = e[at] if t == 0 else (forward[at - 1] @ a) * e[at]
        forward[at] = now / now.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(len(going) - 1, 0, -1):
        at = start[: going[t]] + t
        ahead = e[at] * backward[at]
        back = ahead @ a.T
        joint = forward[at - 1][:, :, None] * a * ahead[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[at - 1] = back / back.sum(axis=1, keepdims=True)
    out = forward * backward
    return out / out.sum(axis=1, keepdims=True), pairs


def sample(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> list[tuple[str, str]]:
    """Language and some text of about ``fit_docs`` documents of each language, chosen by a hash of doc_id."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return []
    rates = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, fit_docs / n)])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - fit_chars + 1)).cast("int") + 1
    rows = known.where(draw < F.element_at(rates, F.col("lang"))).select(
        "lang", F.substr("text", place, F.lit(fit_chars)).alias("text")
    )
    return sorted((r["lang"], r["text"]) for r in rows.collect())


def fit(rows: list[tuple[str, str]], epochs: int = EPOCHS) -> Model:
    """Weights that make the labels of the sample likely, by AdaGrad on the log-likelihood."""
    labels = sorted({lang for lang, _ in rows})
    k = len(labels)
    weights, transitions = np.zeros((1 << TABLE_BITS, k)), np.zeros((k, k))
    if not rows:
        return Model(labels, weights.astype(np.float32), transitions)
    words = lowered(pa.array([t for _, t in rows], pa.large_string()))
    label = np.repeat([labels.index(lang) for lang, _ in rows], words.count)
    rng = np.random.default_rng(SEED)
    sizes = rng.integers(4, 40, size=len(label) // 4 + len(rows) + 1)
    cuts = np.unique(np.concatenate([np.cumsum(sizes), words.first]))
    cuts = cuts[cuts <= len(label)]
    pieces = [np.arange(low, high) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    order = np.concatenate([pieces[i] for i in rng.permutation(len(pieces))])
    label = label[order]
    place_of, word_of = features(words)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word_of = rank[word_of]
    by_word = np.argsort(word_of, kind="stable")
    place_of, word_of = place_of[by_word], word_of[by_word]

    squares, squares_t = np.full_like(weights, 1e-2), np.full_like(transitions, 1e-2)
    batches = [(low, min(low + BATCH_WORDS, len(label))) for low in range(0, len(label), BATCH_WORDS)]
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            low, high = batches[b]
            f_low, f_high = np.searchsorted(word_of, [low, high])
            place, word, own = place_of[f_low:f_high], word_of[f_low:f_high] - low, label[low:high]
            emissions = _summed(weights[place], word, high - low)
            start, length = chains(np.array([0, high - low]))
            probability, pairs = marginals(emissions, transitions, start, length)
            miss = -probability
            miss[np.arange(high - low), own] += 1
            gradient = np.stack([np.bincount(place, miss[word, c], 1 << TABLE_BITS) for c in range(k)], axis=1)
            inside = np.ones(high - low, bool)
            inside[start] = False
            after = np.flatnonzero(inside)
            seen = np.zeros((k, k))
            np.add.at(seen, (own[after - 1], own[after]), 1)
            gradient /= np.sqrt(high - low)
            gradient_t = (seen - pairs) / np.sqrt(high - low)
            squares += gradient**2
            squares_t += gradient_t**2
            weights += 0.1 * gradient / np.sqrt(squares)
            transitions += 0.1 * gradient_t / np.sqrt(squares_t)
    return Model(labels, weights.astype(np.float32), transitions)


def word_probabilities(model: Model, texts: pa.Array) -> tuple[Words, np.ndarray]:
    words = lowered(texts)
    place, word = features(words)
    emissions = _summed(model.weights[place], word, len(words.start))
    start, length = chains(words.first)
    return words, marginals(emissions, model.transitions, start, length)[0]


def judged(model: Model, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document the language, the score, the words, and how often the likeliest label changes."""
    names, n = np.array([*model.labels, UNKNOWN], object), part.num_rows
    if not model.labels:
        none = np.zeros(n, np.int64)
        return names[none], np.zeros(n), none, none
    words, probability = word_probabilities(model, part.column("text"))
    share = _summed(probability, words.doc, n) / np.maximum(words.count, 1)[:, None]
    known = part.column("has_letter").to_numpy(zero_copy_only=False) & (words.count > 0)
    best = np.where(known, share.argmax(axis=1), len(names) - 1)
    score = np.where(known, np.clip(share.max(axis=1), 0, 1), 0.0)
    top, doc = probability.argmax(axis=1), words.doc
    change = np.r_[False, (top[1:] != top[:-1]) & (doc[1:] == doc[:-1])][: len(top)]
    return names[best], score, words.count, np.bincount(doc[change], minlength=n)


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def label_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words and n_switches of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lang, score, count, switches = judged(shared.value, part)
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "held_out": part.column("held_out"),
                    "lang_pred": pa.array(lang, pa.string()),
                    "score": pa.array(score, pa.float64()),
                    "n_words": pa.array(count, pa.int64()),
                    "n_switches": pa.array(switches, pa.int64()),
                }
            )

    rows = docs.select("doc_id", "text", held_out().alias("held_out"), has_letter().alias("has_letter"))
    return in_batches(rows, label, LABEL_SCHEMA)


def confidence(model: Model, part: pa.RecordBatch) -> np.ndarray:
    """Of each document the mean probability of its words' likeliest languages; 0 without a letter, a word or a label."""
    if not model.labels:
        return np.zeros(part.num_rows)
    words, probability = word_probabilities(model, part.column("text"))
    total = np.bincount(words.doc, probability.max(axis=1), part.num_rows)
    return np.where(part.column("has_letter").to_numpy(zero_copy_only=False), total / np.maximum(words.count, 1), 0.0)


def in_a_language(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents, all of their columns, whose words are in languages with at least that mean probability.

    They need not be in one language: a text that switches evenly between three has a third
    of its words in each, and yet each of them in one for certain.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sure = confidence(shared.value, part)
            good = pa.array((sure > 0) & (sure >= least))
            yield pa.record_batch({"document": part.column("document").filter(good)})

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "text", has_letter().alias("has_letter")
    )
    return in_batches(rows, choose, rows.select("document").schema).select("document.*")


def label_runs(docs: DataFrame, model: Model) -> DataFrame:
    """The pieces of one language in every document: first word, words, language, mean probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches):
            words, probability = word_probabilities(model, part.column("text"))
            top, doc = probability.argmax(axis=1), words.doc
            at = np.flatnonzero(np.r_[True, (top[1:] != top[:-1]) | (doc[1:] != doc[:-1])][: len(top)])
            size = np.diff(np.r_[at, len(top)])
            mean = np.add.reduceat(probability.max(axis=1), at) / size if len(at) else np.zeros(0)
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id").take(pa.array(doc[at])),
                    "first_word": pa.array(at - words.first[doc[at]], pa.int64()),
                    "n_words": pa.array(size, pa.int64()),
                    "lang": pa.array([model.labels[i] for i in top[at]], pa.string()),
                    "score": pa.array(mean, pa.float64()),
                }
            )

    if not model.labels:
        return docs.sparkSession.createDataFrame([], RUN_SCHEMA)
    return in_batches(docs.select("doc_id", "text"), runs, RUN_SCHEMA)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Fit on the labelled documents that are not held out, and label all documents."""
    return label_documents(docs, fit(sample(docs, **bounds)))
