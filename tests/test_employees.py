"""The employee table through every step, exact rows per version."""

import pytest
from pyspark.errors import PySparkValueError

from palimpsest import create_or_replace, delete, files, history, read, snapshots, update

from .conftest import rows
from .employees import (
    AFTER_DELETE,
    AFTER_UPDATE,
    IN_DATA_ENGINEERING,
    IN_PRODUCT,
    RAISE,
    ROWS,
    SCHEMA,
)


@pytest.mark.parametrize("format", ["parquet", "orc"])
@pytest.mark.parametrize("partition_by", [[], ["departamento"]])
def test_every_version(spark, table, format, partition_by):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert create_or_replace(df, table, format=format, partition_by=partition_by) == 1
    assert rows(read(table)) == sorted(ROWS, key=repr)
    assert read(table).columns == SCHEMA.names

    assert update(table, IN_DATA_ENGINEERING, RAISE) == 2
    assert rows(read(table)) == sorted(AFTER_UPDATE, key=repr)

    assert delete(table, IN_PRODUCT) == 3
    assert rows(read(table)) == sorted(AFTER_DELETE, key=repr)

    assert rows(read(table, 1)) == sorted(ROWS, key=repr)
    assert rows(read(table, 2)) == sorted(AFTER_UPDATE, key=repr)
    assert rows(history(table).select("version", "parent", "operation", "is_current_ancestor")) == [
        (1, None, "create", True),
        (2, 1, "update", True),
        (3, 2, "delete", True),
    ]
    assert rows(snapshots(table).select("version", "total_records")) == [(1, 8), (2, 8), (3, 6)]
    assert sum(r["record_count"] for r in files(table).collect()) == 6


def test_partition_left_empty(spark, table):
    create_or_replace(spark.createDataFrame(ROWS, SCHEMA), table, partition_by=["departamento"])
    delete(table, IN_PRODUCT)
    assert "departamento=Produto" not in {r["partition"] for r in files(table).collect()}
    assert "departamento=Engenharia de Dados" in {r["partition"] for r in files(table).collect()}
    summary = snapshots(table).where("version = 2").first()
    assert (summary["removed_records"], summary["added_files"]) == (2, 0)


def test_null_in_condition(spark, table):
    extra = (9, "N", None, None, None, None)
    create_or_replace(spark.createDataFrame([*ROWS, extra], SCHEMA), table)
    update(table, IN_DATA_ENGINEERING, RAISE)
    delete(table, IN_PRODUCT)
    assert extra in rows(read(table))
    assert read(table).count() == 7


def test_not_null_is_checked_when_rows_are_made(spark):
    with pytest.raises(PySparkValueError, match="FIELD_NOT_NULLABLE_WITH_NAME"):
        spark.createDataFrame([(None, *ROWS[0][1:])], SCHEMA)


def test_repeated_rows(spark, table):
    create_or_replace(spark.createDataFrame([ROWS[0], ROWS[0]], SCHEMA), table)
    update(table, "id = 1", {"salario": 1.0})
    assert rows(read(table)) == [(*ROWS[0][:4], 1.0, ROWS[0][5])] * 2


def test_partition_column_assigned(spark, table):
    create_or_replace(spark.createDataFrame(ROWS, SCHEMA), table, partition_by=["departamento"])
    update(table, "id = 1", {"departamento": "'DevOps'"})
    want = [(*r[:2], "DevOps", *r[3:]) if r[0] == 1 else r for r in ROWS]
    assert rows(read(table)) == sorted(want, key=repr)
    assert rows(read(table).where("departamento = 'DevOps'").select("id")) == [(1,), (6,)]
