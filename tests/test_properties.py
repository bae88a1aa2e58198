"""Random statements against a plain Python list, and rules that hold for any condition."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest import create_or_replace, delete, deleted, read, update, updated

from .conftest import rows

SCHEMA = "k int, p string, v double"


def random_rows(seed, n=60):
    """NULLs everywhere, repeated rows, and partition values that need care in paths."""
    r = random.Random(seed)
    values = ["007", "a b+c/ç=%}", "{x}", "*?[y]", "tail ", None, "Ünï"]
    out = [(r.choice([None, *range(9)]), r.choice(values), r.choice([None, 1.5, -2.0, 7.25])) for _ in range(n)]
    return out + out[:5]


def any_true(*values):
    """SQL's OR."""
    return True if True in values else None if None in values else False


# SQL text, and the same as a Python function that gives True, False or None.
CONDITIONS = [
    ("k > 4", lambda k, p, v: None if k is None else k > 4),
    ("p = '007'", lambda k, p, v: None if p is None else p == "007"),
    ("p = 'a b+c/ç=%}' OR v < 0", lambda k, p, v: any_true(p and p == "a b+c/ç=%}", None if v is None else v < 0)),
    ("p IS NULL", lambda k, p, v: p is None),
    ("v IS NOT NULL AND k = 3", lambda k, p, v: False if v is None else (None if k is None else k == 3)),
]
ASSIGNMENTS = [
    ({"v": "v * 2", "k": "v"}, lambda k, p, v: (None if v is None else int(v), p, None if v is None else v * 2)),
    ({"p": "'{x}'"}, lambda k, p, v: (k, "{x}", v)),
    ({"p": None, "k": 5}, lambda k, p, v: (5, None, v)),
]


@pytest.mark.parametrize(("seed", "partition_by"), [(1, ["p"]), (2, []), (3, ["p", "k"])])
def test_random_statements(spark, table, seed, partition_by):
    r = random.Random(seed)
    state = random_rows(seed)
    create_or_replace(spark.createDataFrame(state, SCHEMA).repartition(3), table, partition_by=partition_by)
    states = [state]
    for _ in range(4):
        text, condition = r.choice(CONDITIONS)
        if r.random() < 0.6:
            assignments, change = r.choice(ASSIGNMENTS)
            state = [change(*x) if condition(*x) is True else x for x in state]
            update(table, text, assignments)
        else:
            state = [x for x in state if condition(*x) is not True]
            delete(table, text)
        states.append(state)
    for version, want in enumerate(states, start=1):
        assert rows(read(table, version)) == sorted(want, key=repr), (version, seed)


def test_false_condition_changes_nothing(spark, table):
    state = random_rows(4)
    create_or_replace(spark.createDataFrame(state, SCHEMA), table, partition_by=["p"])
    assert update(table, "k > 100", {"v": 0.0}) == 2
    assert delete(table, "p = 'nowhere'") == 3
    assert rows(read(table)) == sorted(state, key=repr)


def test_delete_all_then_nothing_is_left(spark, table):
    create_or_replace(spark.createDataFrame(random_rows(5), SCHEMA), table, partition_by=["p"])
    delete(table, F.lit(True))
    assert read(table).count() == 0
    assert read(table).columns == ["k", "p", "v"]
    assert update(table, F.lit(True), {"v": 1.0}) == 3
    assert read(table, 1).count() == 65


@pytest.mark.parametrize("text", [c[0] for c in CONDITIONS])
def test_delete_keeps_what_the_condition_is_not_true_for(spark, text):
    df = spark.createDataFrame(random_rows(6), SCHEMA)
    both = deleted(df, text).unionByName(df.where(text))
    assert rows(both) == rows(df)


def test_update_sees_the_old_row_and_keeps_types(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], SCHEMA)
    new = updated(df, "k = 1", {"k": "k * 1.9", "v": "k + 10"})
    assert rows(new) == [(1, "a", 11.0), (2, "b", 3.0)]
    assert new.dtypes == df.dtypes
