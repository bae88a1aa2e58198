import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat

SCHEMA = "conv_id bigint, turn int, role string, text string, line string, state string, code string"


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    n = int(np.prod(chat.SIZES))
    model = chat.Model(rng.normal(size=6), rng.normal(size=(6, 6)), rng.normal(size=(6, n)))
    codes = rng.integers(0, n, 5)

    def weight(path):
        seen = model.start[path[0]] + sum(model.seen[s, c] for s, c in zip(path, codes, strict=True))
        return seen + sum(model.step[a, b] for a, b in itertools.pairwise(path))

    assert tuple(chat.viterbi(model, codes)) == max(itertools.product(range(6), repeat=5), key=weight)


@pytest.mark.parametrize(
    "line, role, rest",
    [
        ("User: hi", 2, "hi"),
        ("**Human:** hi", 2, "hi"),
        ("### Assistant", 3, ""),
        ("<|im_start|>system", 1, ""),
        ("[Bot] hi", 3, "hi"),
        ("Q: why?", 2, "why?"),
        ("Usual: hi", 0, "Usual: hi"),
        ("a user said: hi", 0, "a user said: hi"),
    ],
)
def test_markers(spark, line, role, rest):
    row = spark.createDataFrame([(line,)], "line string").select(
        chat.marker(F.col("line")), chat.without_marker(F.col("line"))
    )
    assert tuple(row.first()) == (role, rest)


@pytest.fixture(scope="module")
def model(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    return chat.fit(chat.observed(chat.transcript_lines(conversations)).where(chat.learned_from()))


def test_roles_of_held_out_conversations(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = chat.format_conversations(conversations).where(~chat.learned_from()).orderBy("turn").toPandas()
    want = conversations.where(~chat.learned_from()).orderBy("turn").toPandas()
    want = want.groupby("conv_id")["role"].apply(list)
    roles = got.groupby("conv_id")["role"].apply(list)
    assert set(roles.index) == set(want.index)
    assert np.mean([roles[c] == want[c] for c in want.index]) >= 0.8


def test_a_raw_transcript(spark, model):
    text = "SYSTEM: Be kind.\n\nHuman: What is it?\nAnd why?\n\nAI: It is so.\nBecause of that.\n\nHuman: Thanks."
    lines = chat.observed(chat.lines_of(spark.createDataFrame([(1, text), (2, None), (None, "Q: x")], "conv_id bigint, text string")))
    out = chat.turns(lines, model).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in out] == [
        (None, "user", "x"),
        (1, "system", "Be kind."),
        (1, "user", "What is it?\nAnd why?"),
        (1, "assistant", "It is so.\nBecause of that."),
        (1, "user", "Thanks."),
    ]
    assert out[1]["rendered"] == "<|system|>\nBe kind.\n<|end|>"


def test_defined_cases(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, None), (1, 0, "user", "a"), (2, None, "User", ""), (None, 0, "other", "x?")]
    rows += [(3, i, ("user", "assistant")[i % 2], "long " * 5000) for i in range(6)]
    out = chat.format_conversations(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()
    assert {r["conv_id"] for r in out} == {1, 2, 3, None}
    assert sum(r["n_lines"] for r in out) >= len(rows) - 1
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
