"""ALTER TABLE: what reads give before and after, and that no data file is touched."""

import pytest

from palimpsest import (
    add_column,
    append,
    create_or_replace,
    drop_column,
    files,
    read,
    rename_column,
    snapshots,
    update,
    widen_column,
)

from .conftest import rows

ROWS = [(1, "a", 1.5), (2, "b", 2.5), (3, "a", None)]
SCHEMA = "k int, p string, v float"


@pytest.mark.parametrize("format", ["parquet", "orc"])
def test_all_changes(spark, table, format):
    create_or_replace(spark.createDataFrame(ROWS, SCHEMA), table, format=format, partition_by=["p"])
    data = rows(files(table).select("file_path"))
    add_column(table, "note", "string")
    rename_column(table, "p", "part")
    widen_column(table, "k", "bigint")
    widen_column(table, "v", "double")
    drop_column(table, "note")
    add_column(table, "Note", "int")
    assert rows(files(table).select("file_path")) == data
    assert read(table).dtypes == [("k", "bigint"), ("part", "string"), ("v", "double"), ("Note", "int")]
    assert rows(read(table)) == sorted(((k, p, v, None) for k, p, v in ROWS), key=repr)
    assert read(table, 1).dtypes == [("k", "int"), ("p", "string"), ("v", "float")]
    assert rows(read(table, 1)) == sorted(ROWS, key=repr)
    assert read(table, 2).columns == ["k", "p", "v", "note"]

    # Old int files answer questions about values an int cannot hold.
    assert read(table).where("k > 2").count() == 1
    assert read(table).where("k > 4294967296").count() == 0
    assert read(table).where(f"k < {2**40}").count() == 3
    update(table, "part = 'a'", {"k": f"k + {2**40}", "note": "7"})
    want = [(1 + 2**40, "a", 1.5, 7), (2, "b", 2.5, None), (3 + 2**40, "a", None, 7)]
    assert rows(read(table)) == sorted(want, key=repr)
    assert read(table).where(f"k > {2**40}").count() == 2


def test_dropped_values_do_not_come_back(spark, table):
    create_or_replace(spark.createDataFrame(ROWS, SCHEMA), table)
    drop_column(table, "v")
    add_column(table, "v", "float")
    assert rows(read(table).select("v").distinct()) == [(None,)]
    append(spark.createDataFrame([(9, 0.5)], "k int, v float"), table)
    assert rows(read(table).where("v IS NOT NULL")) == [(9, None, 0.5)]
    assert rows(read(table, 1)) == sorted(ROWS, key=repr)


def test_names_that_need_care(spark, table):
    df = spark.createDataFrame([(1, 2, 3)], ["write_id", "a.b", "c`d"])
    create_or_replace(df, table)
    update(table, "`a.b` = 2", {"a.b": 5, "write_id": "`c``d` + 1"})
    assert read(table).columns == df.columns
    assert rows(read(table)) == [(4, 5, 3)]


def test_refused(spark, table):
    create_or_replace(spark.createDataFrame(ROWS, SCHEMA), table, partition_by=["p"])
    with pytest.raises(ValueError, match="partitions the table"):
        drop_column(table, "p")
    with pytest.raises(ValueError, match="already"):
        add_column(table, "K", "int")
    with pytest.raises(ValueError, match="already"):
        rename_column(table, "k", "V")
    with pytest.raises(ValueError, match="not wider"):
        widen_column(table, "v", "int")
    with pytest.raises(ValueError, match="no column"):
        drop_column(table, "nothing")
    assert snapshots(table).count() == 1
