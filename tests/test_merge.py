"""MERGE against a plain Python model, in both ways of joining, and its errors."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest import (
    RepeatedSourceKey,
    create_or_replace,
    files,
    insert_row,
    merge,
    read,
    remove_row,
    set_columns,
    snapshots,
)

import palimpsest.operators.merge as merging

from .conftest import rows

TARGET = "k int, p string, v double"
SOURCE = "k int, p string, v double, op string"


def make(n, keys, ops, seed, unique):
    """Rows with NULL keys, NULL values and, unless unique, repeated keys."""
    r = random.Random(seed)
    out, seen = [], set()
    for _ in range(n):
        k = r.choice([None, *range(keys)])
        if unique and k is not None and k in seen:
            continue
        seen.add(k)
        row = (k, r.choice(["a", "b", "c d", None]), r.choice([None, float(r.randrange(100))]))
        out.append((*row, r.choice(ops)) if ops else row)
    return out


def model(target, source, by_source):
    """Delete on 'd', update on 'u', leave others; insert 'u' and 'i'; by source: drop NULL values."""
    by_key = {s[0]: s for s in source if s[0] is not None}
    out, hit = [], set()
    for k, p, v in target:
        s = by_key.get(k) if k is not None else None
        if s:
            hit.add(k)
            if s[3] == "d":
                continue
            out.append((k, s[1], s[2]) if s[3] == "u" else (k, p, v))
        elif by_source and v is None:
            continue
        elif by_source and v > 50:
            out.append((k, p, v / 2))
        else:
            out.append((k, p, v))
    out += [s[:3] for s in source if (s[0] is None or s[0] not in hit) and s[3] in ("u", "i")]
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    ("broadcast", "by_source", "partition_by"),
    [(True, False, ["p"]), (True, True, []), (False, False, []), (False, True, ["p"])],
)
def test_against_model(spark, table, broadcast, by_source, partition_by):
    target = make(120, 40, None, 1, unique=False)
    source = make(60, 60, ["u", "i", "d", "x"], 2, unique=True)
    create_or_replace(spark.createDataFrame(target, TARGET).repartition(5), table, partition_by=partition_by)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        merge(
            table,
            spark.createDataFrame(source, SOURCE),
            ["k"],
            matched=[remove_row("s.op = 'd'"), set_columns({"p": "s.p", "v": F.col("s.v")}, "s.op = 'u'")],
            not_matched=[insert_row(condition="s.op IN ('u', 'i')")],
            not_matched_by_source=(
                [remove_row("t.v IS NULL"), set_columns({"v": "t.v / 2"}, "t.v > 50")] if by_source else []
            ),
        )
        assert rows(read(table)) == model(target, source, by_source)
        assert rows(read(table, 1)) == sorted(target, key=repr)
        assert sum(r["record_count"] for r in files(table).collect()) == read(table).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_merge_with_itself_changes_nothing(table, orders):
    create_or_replace(orders, table, partition_by=["o_orderpriority"])
    merge(
        table,
        read(table),
        "o_orderkey",
        matched=[set_columns()],
        not_matched=[insert_row()],
        not_matched_by_source=[remove_row()],
    )
    assert read(table).exceptAll(orders).isEmpty()
    assert read(table).count() == orders.count()


@pytest.mark.parametrize("broadcast", [True, False])
def test_repeated_source_keys(spark, table, broadcast):
    create_or_replace(spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], TARGET), table)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        twice = spark.createDataFrame([(1, "x", 0.0), (1, "y", 0.0)], TARGET)
        with pytest.raises(RepeatedSourceKey):
            merge(table, twice, "k", matched=[set_columns()])
        with pytest.raises(RepeatedSourceKey):
            merge(table, twice, "k", matched=[remove_row("s.p = 'x'")])
        assert rows(snapshots(table).select("version")) == [(1,)]

        # Repeated, but of no target row: all inserted.
        new = spark.createDataFrame([(7, "x", 0.0), (7, "x", 0.0), (2, "z", 9.0)], TARGET)
        merge(table, new, "k", matched=[set_columns()], not_matched=[insert_row()])
        want = [(1, "a", 1.0), (1, "b", 2.0), (2, "z", 9.0), (7, "x", 0.0), (7, "x", 0.0)]
        assert rows(read(table)) == want

        # Repeated, but only to delete, or only to leave alone.
        merge(table, twice, "k", not_matched_by_source=[set_columns({"v": "-t.v"})])
        want = [(1, "a", 1.0), (1, "b", 2.0), (2, "z", -9.0), (7, "x", -0.0), (7, "x", -0.0)]
        assert rows(read(table)) == want
        merge(table, twice, "k", matched=[remove_row()])
        assert rows(read(table)) == want[2:]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_only_files_with_a_hit_are_rewritten(spark, table):
    rows_by_part = [(i, "ab"[i % 2], float(i)) for i in range(20)]
    create_or_replace(spark.createDataFrame(rows_by_part, TARGET), table, partition_by=["p"])
    before = {r["file_path"]: r["partition"] for r in files(table).collect()}
    merge(table, spark.createDataFrame([(2, "a", 0.0)], TARGET), "k", matched=[set_columns()])
    after = {r["file_path"] for r in files(table).collect()}
    assert {p for path, p in before.items() if path not in after} == {"p=a"}
    assert before.keys() & after


def test_two_keys_and_other_names(spark, table):
    create_or_replace(spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (None, "a", 3.0)], TARGET), table)
    source = spark.createDataFrame([(1, "a", 10.0), (None, "a", 20.0), (1, None, 30.0)], "id int, q string, w double")
    values = {"k": "s.id", "p": "s.q", "v": "s.w"}
    more = set_columns({"v": "s.w + t.v"})
    merge(table, source, {"k": "id", "p": "q"}, matched=[more], not_matched=[insert_row(values)])
    want = [(1, "a", 11.0), (1, "b", 2.0), (None, "a", 3.0), (None, "a", 20.0), (1, None, 30.0)]
    assert rows(read(table)) == sorted(want, key=repr)


def test_source_column_without_a_type(spark, table):
    create_or_replace(spark.createDataFrame([(1, "a", 1.0)], TARGET), table)
    source = spark.range(1, 3).select(F.col("id").alias("k"), F.lit(None).alias("p"), F.lit(2).alias("v"))
    merge(table, source, "k", matched=[set_columns()], not_matched=[insert_row()])
    assert rows(read(table)) == [(1, None, 2.0), (2, None, 2.0)]
    assert read(table).dtypes == [("k", "int"), ("p", "string"), ("v", "double")]


def test_wrong_clauses(spark, table, orders):
    create_or_replace(orders, table)
    with pytest.raises(ValueError, match="needs a clause"):
        merge(table, orders, "o_orderkey")
    with pytest.raises(ValueError, match="not allowed"):
        merge(table, orders, "o_orderkey", matched=[insert_row()])
    with pytest.raises(ValueError, match="only the last clause"):
        merge(table, orders, "o_orderkey", matched=[remove_row(), set_columns()])
    with pytest.raises(ValueError, match="the source has no columns"):
        merge(table, orders.select("o_orderkey"), "o_orderkey", matched=[set_columns()])
    with pytest.raises(ValueError, match="no source row"):
        merge(table, orders, "o_orderkey", not_matched_by_source=[set_columns()])
    with pytest.raises(ValueError, match="no column"):
        merge(table, orders, "nothing", matched=[remove_row()])


def test_paths_are_not_sorted_with_rows(spark, table, monkeypatch):
    """What is joined and sorted to find the files hit holds a number for the file, and the files are the same."""
    monkeypatch.setattr(merging, "_broadcast_limit", lambda table: 0)
    kinds, stage_touched = [], merging.stage_touched
    monkeypatch.setattr(merging, "stage_touched", lambda table, hits, *rest: kinds.append(dict(hits.dtypes)) or stage_touched(table, hits, *rest))
    df = spark.range(0, 200, 1, 8).select(F.col("id").alias("k"), F.lit("a b+%").alias("p"), F.col("id").cast("double").alias("v"))
    create_or_replace(df, table, partition_by=["p"], cluster=False)
    old = {r["file_path"] for r in files(table).select("file_path").collect()}
    source = spark.range(30, 45).select(F.col("id").alias("k"), F.lit(2.0).alias("w"))
    merge(table, source, "k", matched=[remove_row("s.k = 31"), set_columns({"v": "s.w"}, "t.v > 40")])
    assert kinds == [{"palimpsest_path": "bigint"}]
    assert len(old & {r["file_path"] for r in files(table).select("file_path").collect()}) == 7
    assert sorted(r["k"] for r in read(table).where("v = 2").collect()) == [2, *range(41, 45)]
    merge(table, source, "k", not_matched_by_source=[remove_row("t.k < 25")], not_matched=[insert_row({"k": "s.k"})])
    assert sorted(r["k"] for r in read(table).collect()) == sorted({*range(25, 200)} - {31} | {31})
