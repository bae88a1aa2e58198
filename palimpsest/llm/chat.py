"""Transcripts to turns: a hidden Markov model over lines, Viterbi, and one canonical rendering.

A line is in one of six states: it begins or goes on with a turn of system, user or
assistant. What is seen of it is its speaker marker (none, or one of the usual ways to
name a role), how long it is, whether it asks, and whether a blank line or nothing is
before it. Start, transition and observation probabilities are counts over transcripts
whose roles are known, made with Spark over all of them and smoothed by one; the tables
have as many rows as states and values, whatever the number of lines. Viterbi finds the
likeliest states of a whole transcript; a task holds the codes of one transcript's lines,
two bytes each, and never their text, which is joined back by line number. Turns are
then put together one by one.

Defined cases: a NULL text has no lines, an empty one has one empty line; a transcript
starts a turn with its first line whatever its state; repeated rows of conversations are
turns of their own, after each other; roles are compared without case, and lines of other
or no roles teach the model nothing; conv_id may be NULL and is then one conversation;
without anything to learn from, all probabilities are equal; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_batches, staged

ROLES = ("system", "user", "assistant")
#: How transcripts name the roles.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "you", "customer", "question", "q"),
    "assistant": ("assistant", "bot", "ai", "model", "answer", "a"),
}
#: How often each feature differs: markers, lengths, asks, follows.
SIZES = (4, 5, 2, 2)
STATES = 2 * len(ROLES)  # role * 2, plus 1 where a turn begins


def _pattern(names: tuple[str, ...]) -> str:
    """`Name:`, `**Name**:`, `[Name]`, `### Name`, `<|name|>` or `<|im_start|>name` at the beginning of a line."""
    any_of = "|".join(names)
    return (
        rf"(?i)^\s*(?:(?:\*\*|\[|#{{1,6}}\s*)?(?:{any_of})(?:\*\*|\])?\s*:(?:\*\*)?"
        rf"|\[(?:{any_of})\]|#{{1,6}}\s*(?:{any_of})\s*$|<\|(?:im_start\|>\s*)?(?:{any_of})(?:\|>|\s*$))\s*"
    )


PATTERNS = {role: _pattern(names) for role, names in NAMES.items()}


def lines_of(transcripts: DataFrame, conv_id: str = "conv_id", text: str = "text") -> DataFrame:
    """conv_id, line_no and line of raw transcripts, one row each."""
    return transcripts.select(F.col(conv_id).alias("conv_id"), F.posexplode(F.split(text, "\r?\n"))).toDF(
        "conv_id", "line_no", "line"
    )


def marker(line: Column) -> Column:
    out = F.lit(0)
    for i, role in reversed(list(enumerate(ROLES))):
        out = F.when(line.rlike(PATTERNS[role]), F.lit(i + 1)).otherwise(out)
    return out


def without_marker(line: Column) -> Column:
    for role in ROLES:
        line = F.regexp_replace(line, PATTERNS[role], "")
    return line


def observed(lines: DataFrame) -> DataFrame:
    """The lines with ``code``, which holds all features of each."""
    before = Window.partitionBy("conv_id").orderBy("line_no")
    text = F.trim(without_marker(F.col("line")))
    size = F.length(text)
    length = F.when(size == 0, 0).when(size < 60, 1).when(size < 140, 2).when(size < 300, 3).otherwise(4)
    asks = text.rlike(r"[?¿]\s*$").cast("int")
    follows = F.coalesce((F.trim(F.lag("line").over(before)) == "").cast("int"), F.lit(1))
    code = F.lit(0)
    for n, value in zip(SIZES, (marker(F.col("line")), length, asks, follows), strict=True):
        code = code * n + value
    return lines.withColumn("code", code.cast("smallint"))


@dataclass
class Model:
    """Log probabilities."""

    start: np.ndarray
    step: np.ndarray  # state before x state after
    seen: np.ndarray  # state x code


def fit(lines: DataFrame) -> Model:
    """From lines with conv_id, line_no, code and ``state`` (NULL where it is not known)."""
    before = F.lag("state").over(Window.partitionBy("conv_id").orderBy("line_no"))
    known = lines.select("code", "state", before.alias("before"), (F.col("line_no") == 0).alias("first"))
    counts = known.where("state IS NOT NULL").groupBy("before", "state", "code", "first").count().collect()
    start, step = np.ones(STATES), np.ones((STATES, STATES))
    features = [np.ones((STATES, n)) for n in SIZES]
    for r in counts:  # at most states x states x codes rows
        if r["first"]:
            start[r["state"]] += r["count"]
        elif r["before"] is not None:
            step[r["before"], r["state"]] += r["count"]
        for f, value in enumerate(np.unravel_index(r["code"], SIZES)):
            features[f][r["state"], value] += r["count"]
    features = [np.log(f / f.sum(axis=1, keepdims=True)) for f in features]
    values = np.array(np.unravel_index(np.arange(np.prod(SIZES)), SIZES))
    seen = sum(f[:, v] for f, v in zip(features, values, strict=True))
    return Model(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), seen)


def viterbi(model: Model, codes: np.ndarray) -> np.ndarray:
    """The likeliest states of the lines of one transcript."""
    back = np.zeros((len(codes), STATES), np.int8)
    score = model.start + model.seen[:, codes[0]]
    for t in range(1, len(codes)):
        ways = score[:, None] + model.step
        back[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + model.seen[:, codes[t]]
    out = np.zeros(len(codes), np.int8)
    out[-1] = score.argmax()
    for t in range(len(codes) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def decoded(lines: DataFrame, model: Model) -> DataFrame:
    """conv_id, line_no and state of every line."""
    shared = lines.sparkSession.sparkContext.broadcast(model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        ids, numbers, codes, now = [], [], [], object()

        def done() -> Iterator[pa.RecordBatch]:
            if codes:
                whole = np.concatenate(codes)
                states = viterbi(model, whole)
                yield pa.record_batch(
                    {
                        "conv_id": pa.array([now] * len(whole), pa.int64()),
                        "line_no": pa.array(np.concatenate(numbers), pa.int32()),
                        "state": pa.array(states, pa.int32()),
                    }
                )

        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)] if ids else [0]
            number, code = batch.column("line_no").to_numpy(), batch.column("code").to_numpy()
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if ids[low] != now:
                    yield from done()
                    numbers, codes, now = [], [], ids[low]
                numbers.append(number[low:high].copy())
                codes.append(code[low:high].copy())
        yield from done()

    rows = lines.select("conv_id", "line_no", "code").repartition("conv_id").sortWithinPartitions("conv_id", "line_no")
    return in_batches(rows, decode, "conv_id bigint, line_no int, state int")


def turns(lines: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn, role, n_lines, text and rendered of the turns recovered from observed lines."""
    states = decoded(lines, model).withColumnsRenamed({"conv_id": "id", "line_no": "no"})
    rows = lines.join(states, lines["conv_id"].eqNullSafe(states["id"]) & (lines["line_no"] == states["no"]))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.floor(F.col("state") / 2).cast("int") + 1)
    in_order = Window.partitionBy("conv_id").orderBy("line_no")
    begins = (F.col("state") % 2 == 1) | F.coalesce(F.lag("role").over(in_order) != F.col("role"), F.lit(True))
    rows = (
        rows.withColumn("role", role)
        .withColumn("begins", begins)
        .withColumn("turn", F.sum(F.col("begins").cast("bigint")).over(in_order) - 1)
        .withColumn("line", F.when(F.col("begins"), without_marker(F.col("line"))).otherwise(F.col("line")))
    )
    one = rows.groupBy("conv_id", "turn").agg(
        F.first("role").alias("role"),
        F.count(F.lit(1)).alias("n_lines"),
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all_lines"),
    )
    text = F.trim(F.array_join(F.col("all_lines.line"), "\n"), F.lit(" \n\t\r"))
    return one.withColumn("text", text).select(
        "conv_id",
        "turn",
        "role",
        "n_lines",
        "text",
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")).alias("rendered"),
    )


#: The ways transcripts are written in; {} is the role's name.
STYLES = ("{}: ", "**{}:** ", "[{}] ", "### {}\n", "<|{}|>\n", "{}: ")


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """Conversations written out as raw transcripts: conv_id, line_no, line and the true ``state``.

    A hash of the conversation picks the style and the names, and of every fifth turn or so
    leaves the marker out; half of the styles put blank lines between turns.
    """
    pick = F.xxhash64("conv_id")
    style = F.pmod(pick, F.lit(len(STYLES))).cast("int")
    role = F.lower("role")
    name = F.coalesce("role", F.lit(""))
    for r, names in NAMES.items():
        chosen = F.element_at(F.array(*[F.lit(n) for n in names]), F.pmod(pick, F.lit(len(names))).cast("int") + 1)
        name = F.when(role == r, F.initcap(chosen)).otherwise(name)
    marks = F.lit("")
    for i, s in enumerate(STYLES):
        before, after = s.split("{}")
        marks = F.when(style == i, F.concat(F.lit(before), name, F.lit(after))).otherwise(marks)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    text = F.concat(F.when(bare, F.lit("")).otherwise(marks), F.col("text"))
    text = F.when((style % 2 == 0) & text.isNotNull(), F.concat(text, F.lit("\n"))).otherwise(text)
    known = F.array_position(F.array(*[F.lit(r) for r in ROLES]), role)
    rows = conversations.select(
        "conv_id",
        F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("nth"),
        F.when(known > 0, (known - 1) * 2).cast("int").alias("state"),
        text.alias("text"),
    )
    lines = rows.select("conv_id", "nth", "state", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("nth", "pos")) - 1
    return lines.select(
        "conv_id", number.alias("line_no"), "line", (F.col("state") + (F.col("pos") == 0).cast("int")).alias("state")
    )


def learned_from() -> Column:
    """The conversations a model is fitted on; the others are for measuring."""
    return F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation written out, parsed again by a model fitted on four fifths of them, and rendered."""
    lines = staged(observed(transcript_lines(conversations)), "lines")
    model = fit(lines.where(learned_from()))
    return turns(lines.drop("state"), model)
