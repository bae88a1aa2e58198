"""Rows deleted by position."""

import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest import (
    append,
    changes_between,
    compact,
    create_or_replace,
    delete,
    files,
    insert_row,
    merge,
    merge_where,
    read,
    rename_column,
    set_columns,
    snapshots,
    update,
)
from palimpsest.operators import positions

from .conftest import rows


def numbers(spark, n=1000, parts=10):
    return spark.range(0, n, 1, parts).select("id", F.lit(0).alias("v"), F.concat(F.lit("a b+%"), F.col("id") % 2).alias("p"))


def data_files(table):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{table.path}/data") for f in names if f.startswith("part-")}


@pytest.mark.parametrize("partition_by", [(), ("p",)])
def test_scattered_delete_writes_no_data(spark, table, partition_by):
    create_or_replace(numbers(spark), table, partition_by=partition_by, cluster=False)
    first = rows(read(table))
    stored = data_files(table)
    delete(table, "id % 100 = 7", by_position=0.1)
    delete(table, "id % 100 = 8 OR id % 100 = 7", by_position=0.1)
    assert data_files(table) == stored
    assert rows(read(table)) == [r for r in first if r[0] % 100 not in (7, 8)]
    assert rows(read(table, 2)) == [r for r in first if r[0] % 100 != 7]
    assert rows(read(table, 1)) == first
    assert rows(snapshots(table).select("version", "total_records", "added_files", "removed_records")) == [
        (1, 1000, 10 * (len(partition_by) + 1), 0),
        (2, 990, 0, 10),
        (3, 980, 0, 10),
    ]
    assert files(table).agg(F.sum("record_count")).first()[0] == 980 and read(table).count() == 980
    assert rows(changes_between(table, 2, 3).select("id", "change")) == sorted(((100 * i + 8, "delete") for i in range(10)), key=repr)
    assert rows(changes_between(table, 3, 1).select("id", "change")) == sorted(
        ((100 * i + k, "insert") for i in range(10) for k in (7, 8)), key=repr
    )


def test_a_larger_share_is_written_anew(spark, table):
    create_or_replace(numbers(spark), table, cluster=False)
    # 60 rows of the first file, 2 of every file, all of the last
    delete(table, "id < 60 OR id % 100 IN (7, 8) OR id >= 900", by_position=0.05)
    assert rows(snapshots(table).select("added_files", "removed_files", "total_records"))[0] == (1, 2, 1000 - 60 - 16 - 100)
    delete(table, "id % 100 IN (9, 10, 11, 12)", by_position=0.05)  # now six of a hundred
    want = [i for i in range(60, 900) if i % 100 not in (7, 8, 9, 10, 11, 12)]
    assert [r["id"] for r in read(table).orderBy("id").collect()] == want
    assert snapshots(table).where("version = 3").first()["added_files"] == 8
    delete(table, "id BETWEEN 100 AND 199", by_position=0.05)  # all that is left of a file
    assert snapshots(table).where("version = 4").first()["added_files"] == 0
    assert read(table).count() == len([i for i in want if not 100 <= i < 200])
    assert delete(table, "id = -1", by_position=0.05) == 5 and delete(table, "CAST(NULL AS boolean)", by_position=0.05) == 6
    with pytest.raises(ValueError, match="by_position"):
        delete(table, "id = 1", by_position=1.0)


def test_limits(spark, table, monkeypatch):
    monkeypatch.setattr(positions, "MOST_HOLES", 25)
    monkeypatch.setattr(positions, "MOST_LISTS", 2)
    create_or_replace(numbers(spark), table, cluster=False)
    for i in range(4):
        delete(table, f"id IN ({i}, {100 * i + 50})", by_position=0.5)
    assert read(table).inputFiles() and len(data_files(table)) == 10
    gone = {i for k in range(4) for i in (k, 100 * k + 50)}
    assert {r["id"] for r in read(table).collect()} == set(range(1000)) - gone
    assert {r["id"] for r in read(table, 3).collect()} == set(range(1000)) - {0, 50, 1, 150}
    delete(table, "id % 50 = 20", by_position=0.5)  # 20 more would be 28
    assert len(data_files(table)) > 10 and read(table).count() == 1000 - 28


def test_changes_after_it(spark, table):
    create_or_replace(numbers(spark, 200, 4), table, ranges=["id"], cluster=False)
    delete(table, "id % 50 = 0", by_position=0.1)
    update(table, "id % 50 IN (0, 1)", {"v": "v + 1"}, by_position=0.1)
    update(table, "id = 2", {"v": "v + 5"})
    rename_column(table, "v", "w")
    append(numbers(spark, 1, 1).withColumnRenamed("v", "w"), table)
    merge(table, spark.createDataFrame([(0, 9), (3, 9), (50, 9)], "id bigint, w int").withColumn("p", F.lit("m")), on="id",
          matched=[set_columns()], not_matched=[insert_row()])
    source = spark.createDataFrame([(98, 101)], "low bigint, high bigint")
    merge_where(table, source, "t.id BETWEEN s.low AND s.high", matched=[set_columns({"w": "100"})])
    want = {i: 0 for i in range(200) if i % 50}
    want |= {1: 1, 51: 1, 101: 1, 151: 1} | {2: 5} | {0: 9, 3: 9, 50: 9} | {98: 100, 99: 100, 101: 100}
    assert {r["id"]: r["w"] for r in read(table).collect()} == want and read(table).count() == len(want)
    assert rows(read(table, where="id = 151").select("id", "w")) == [(151, 1)]
    before = rows(read(table))
    compact(table)
    assert rows(read(table)) == before
    assert "LeftAnti" not in read(table)._jdf.queryExecution().toString()  # nothing is left to leave out


def test_orc_and_empty_tables(spark, table):
    create_or_replace(numbers(spark), table, format="orc")
    delete(table, "id % 100 = 7", by_position=0.5)
    assert read(table).count() == 990
    create_or_replace(numbers(spark, 0), table)
    assert update(table, "id = 1", {"v": 1}, by_position=0.5) == 4 and delete(table, "id = 1", by_position=0.5) == 5
    assert rows(read(table)) == []


def test_a_delete_that_dies_changes_nothing(spark, table, monkeypatch):
    create_or_replace(numbers(spark, 100, 2), table, cluster=False)
    with monkeypatch.context() as m:
        m.setattr("palimpsest.operators.write.commit_files", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            delete(table, "id = 7", by_position=0.1)
    assert read(table).count() == 100
    delete(table, "id = 8", by_position=0.1)
    assert read(table).count() == 99


@pytest.mark.parametrize("seed", range(2))
def test_random_statements(spark, table, seed):
    rng = random.Random(seed)
    model = [(rng.choice([None, *range(30)]), rng.randrange(5), rng.choice(["x", "y", None])) for _ in range(300)]
    schema = "k int, v int, p string"
    create_or_replace(spark.createDataFrame(model, schema).repartition(5), table, partition_by=rng.choice([[], ["p"]]), cluster=False)
    versions = [list(model)]
    for _ in range(5):
        k, share = rng.randrange(30), rng.choice([0.0, 0.05, 0.3])
        what = rng.choice(["delete", "update", "update", "delete"])
        if what == "delete":
            delete(table, f"k = {k} AND v < 3", by_position=share)
            model = [r for r in model if not (r[0] == k and r[1] < 3)]
        else:
            update(table, f"k BETWEEN {k} AND {k + 1}", {"v": "v + 1", "p": "'y'"}, by_position=share)
            model = [(r[0], r[1] + 1, "y") if r[0] is not None and k <= r[0] <= k + 1 else r for r in model]
        versions.append(list(model))
    for n, want in enumerate(versions, 1):
        assert rows(read(table, n)) == sorted(want, key=repr)
