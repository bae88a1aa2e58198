"""Replace, append, log, catalog, SQL, checks and errors."""

import os
from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import (
    CheckFailed,
    ConcurrentWrite,
    Table,
    UnknownTable,
    UnknownVersion,
    append,
    create_namespace,
    create_or_replace,
    delete,
    files,
    history,
    list_catalogs,
    list_tables,
    read,
    read_raw,
    register_metadata_views,
    register_views,
    snapshots,
    sql,
    update,
    validate,
    widen_column,
)
from palimpsest.sources import log
from palimpsest.sources.table import new_write_id

from .conftest import rows

ROWS = [(1, "a", 1.0), (2, "b", 2.0), (3, "a", 3.0), (None, None, None)]
SCHEMA = "k int, p string, v double"


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_replace_keeps_old_versions(table, df):
    create_or_replace(df, table, partition_by=["p"])
    delete(table, "p = 'a'")
    assert create_or_replace(read(table).select("v", F.lit(1).alias("n")), table, format="orc") == 3
    append(df.select("v"), table)
    assert rows(read(table)) == sorted([(2.0, 1), (None, 1), *((v, None) for _, _, v in ROWS)], key=repr)
    assert rows(read(table, 1)) == sorted(ROWS, key=repr)
    assert rows(read(table, 2)) == sorted([ROWS[1], ROWS[3]], key=repr)
    assert rows(history(table).select("version", "parent", "operation", "is_current_ancestor")) == [
        (1, None, "create", False),
        (2, 1, "delete", False),
        (3, None, "replace", True),
        (4, 3, "append", True),
    ]
    counts = snapshots(table).select("version", "total_records", "added_records", "removed_records")
    assert rows(counts) == [(1, 4, 4, 0), (2, 2, 0, 2), (3, 2, 2, 2), (4, 6, 4, 0)]


def test_file_list(table, df):
    create_or_replace(df, table, partition_by=["p"])
    for r in files(table).collect():
        assert os.path.getsize(r["file_path"]) == r["file_size_in_bytes"]
    counts = files(table).groupBy("partition").agg(F.sum("record_count"))
    assert rows(counts) == [("p=__HIVE_DEFAULT_PARTITION__", 1), ("p=a", 2), ("p=b", 1)]
    assert all(".zstd." in r["file_path"] for r in files(table).collect())


def test_unknown(spark, root, table, df):
    with pytest.raises(UnknownTable):
        read(table)
    with pytest.raises(UnknownTable):
        history(table)
    create_or_replace(df, table)
    for version in (0, 2):
        with pytest.raises(UnknownVersion):
            read(table, version)
    with pytest.raises(ValueError, match="not a valid name"):
        Table(spark, root, "ns", "a/b")


def test_refused_before_anything_is_written(table, df):
    with pytest.raises(ValueError, match="cannot partition by v"):
        create_or_replace(df, table, partition_by=["v"])
    with pytest.raises(ValueError, match="format"):
        create_or_replace(df, table, format="csv")
    create_or_replace(df, table)
    with pytest.raises(ValueError, match="same answer every time"):
        delete(table, F.rand() < 0.5)
    with pytest.raises(ValueError, match="no column"):
        update(table, "k = 1", {"nothing": 1})
    with pytest.raises(ValueError, match="assigned twice"):
        update(table, "k = 1", {"v": 1, "V": 2})
    with pytest.raises(ValueError, match="no columns"):
        append(df.withColumn("extra", F.lit(1)), table)
    with pytest.raises(AnalysisException):
        delete(table, "nothing = 1")
    assert snapshots(table).count() == 1


def test_empty_partition_value_is_refused(spark, table):
    bad = spark.createDataFrame([(1, ""), (2, "a")], "k int, p string")
    with pytest.raises(Exception, match="cannot hold ''"):
        create_or_replace(bad, table, partition_by=["p"])
    with pytest.raises(UnknownTable):
        read(table)
    assert create_or_replace(bad, table) == 1


def test_what_a_crashed_write_left_is_not_read(spark, table, df):
    create_or_replace(df, table)
    # Data written, log row not: nobody reads it, and the next write goes on.
    df.write.parquet(table.data_dir(new_write_id(2)))
    # Log folder made, log row not.
    os.makedirs(table.log_dir(2) + "/_temporary/0")
    assert rows(read(table)) == sorted(ROWS, key=repr)
    assert update(table, "k = 1", {"v": 0.0}) == 2
    assert rows(read(table)) == sorted([(1, "a", 0.0), *ROWS[1:]], key=repr)


def test_version_made_by_two_writers_is_refused(table, df):
    create_or_replace(df, table)
    log.log_rows(table).where("version = 1").drop("version").write.mode("append").parquet(table.log_dir(1))
    with pytest.raises(ConcurrentWrite):
        read(table)


def test_types_that_partition(spark, table):
    columns = "k int, d date, b boolean, n bigint, s smallint"
    days = [date(2024, 2, 29), date(1969, 12, 31), None]
    state = [(i, days[i % 3], [True, False, None][i % 3], [-(2**40), 0, None][i % 3], i % 2) for i in range(12)]
    create_or_replace(spark.createDataFrame(state, columns), table, partition_by=["d", "b", "n", "s"])
    assert rows(read(table)) == sorted(state, key=repr)
    assert read(table).dtypes == [("k", "int"), ("d", "date"), ("b", "boolean"), ("n", "bigint"), ("s", "smallint")]
    update(table, "d = DATE '2024-02-29'", {"d": date(2024, 3, 1), "n": None})
    state = [(k, date(2024, 3, 1), b, None, s) if d == days[0] else (k, d, b, n, s) for k, d, b, n, s in state]
    assert rows(read(table)) == sorted(state, key=repr)
    widen_column(table, "s", "bigint")
    delete(table, "s = 1 AND b IS NULL")
    state = [r for r in state if not (r[4] == 1 and r[2] is None)]
    assert rows(read(table)) == sorted(state, key=repr)


def test_second_writer_is_refused(table, df, monkeypatch):
    create_or_replace(df, table)
    append(df, table)
    stale = log.version_at(table, 1)
    monkeypatch.setattr("palimpsest.operators.change.version_at", lambda t: stale)
    with pytest.raises(ConcurrentWrite):
        update(table, "k = 1", {"v": 0.0})
    assert read(table).count() == 8


def test_staging_goes_to_the_folder_the_cluster_names(spark, table, df):
    create_or_replace(df, table)
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared + "/datalake/t")) if os.path.isdir(shared + "/datalake/t") else set()
    update(table, "k = 1", {"v": 0.0})
    assert len(set(os.listdir(shared + "/datalake/t")) - before) == 1
    assert not os.path.exists(table.path + "/staging")


def test_staging_is_in_the_table_where_the_cluster_names_no_folder(root):
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default))
    table = Table(spark, root, "datalake", "t")
    assert table.staging_dir("v1-x", "touched") == f"{root}/datalake/t/staging/v1-x/touched"


def test_catalog_and_sql(spark, root, df):
    assert "spark_catalog" in list_catalogs(spark)
    create_namespace(spark, "lake_ns", root)
    create_namespace(spark, "lake_ns", root)
    assert "lake_ns" in [d.name for d in spark.catalog.listDatabases()]
    assert list_tables(spark, root, "lake_ns") == []
    one, two = Table(spark, root, "lake_ns", "one"), Table(spark, root, "lake_ns", "two")
    create_or_replace(df, one)
    create_or_replace(df.select("k"), two)
    delete(one, "p = 'a'")
    assert list_tables(spark, root, "lake_ns") == ["one", "two"]
    joined = sql(spark, root, "lake_ns", "SELECT two.k, v FROM two LEFT JOIN one ON one.k = two.k")
    assert rows(joined) == [(1, None), (2, 2.0), (3, None), (None, None)]
    assert register_metadata_views(one) == ["one_history", "one_snapshots", "one_files"]
    assert spark.sql("SELECT sum(record_count) FROM one_files").first()[0] == 2
    assert spark.sql("SELECT operation FROM one_history WHERE version = 2").first()[0] == "delete"
    assert register_views(spark, root, "lake_ns", names=["two"]) == ["two"]
    register_views(spark, root, "lake_ns", versions={"one": 1})
    assert spark.sql("SELECT count(*) FROM one").first()[0] == 4
    with pytest.raises(ValueError, match="no tables"):
        register_views(spark, root, "lake_ns", versions={"three": 1})


def test_raw_files(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("id,day,other\n1,2024-05-01,x\n2,,y\n")
    got = read_raw(spark, str(tmp_path), "id int, day date", "csv", header="true")
    assert got.dtypes == [("id", "int"), ("day", "date")]
    assert [str(r["day"]) for r in got.orderBy("id").collect()] == ["2024-05-01", "None"]
    (tmp_path / "bad.csv").write_text("id,day,other\nnot a number,2024-05-01,x\n")
    with pytest.raises(Exception, match="not a int"):
        read_raw(spark, str(tmp_path), "id int", "csv", header="true").collect()


def test_validate(df):
    assert validate(df, min_rows=4, expected_rows=4, schema=T.StructType.fromDDL(SCHEMA)) == 4
    with pytest.raises(CheckFailed) as e:
        validate(
            df.unionAll(df.where("k = 1")),
            min_rows=6,
            expected_rows=4,
            not_null=["k", "p"],
            unique=["k"],
            schema=T.StructType.fromDDL("k bigint, p string, v double"),
        )
    assert len(e.value.failures) == 6
    with pytest.raises(CheckFailed, match="no columns"):
        validate(df, not_null=["nothing"])


@pytest.mark.parametrize(
    "values, old, new",
    [
        ([1.7], "double", "int"),
        ([3.0, 2.5], "double", "bigint"),
        ([2**53 + 1], "bigint", "double"),
        (["1.239"], "string", "decimal(10,2)"),
        (["2024-05-01 13:00:00"], "string", "date"),
        ([0.1], "double", "float"),
    ],
)
def test_raw_values_lose_no_part(spark, root, values, old, new):
    df = spark.createDataFrame([(v,) for v in values], f"x {old}")
    df.write.parquet(f"{root}/raw")
    with pytest.raises(Exception, match="x: not a"):
        read_raw(spark, f"{root}/raw", f"x {new}").collect()
    assert read_raw(spark, f"{root}/raw", f"x {new}", may_cut=["x"]).count() == len(values)
    t = Table(spark, root, "datalake", "cut")
    create_or_replace(spark.createDataFrame([], f"x {new}"), t)
    with pytest.raises(Exception, match="x: not a"):
        append(df, t)


def test_raw_values_that_fit(spark, root):
    row = (3.0, 5, "1.50", "2024-05-01", float("nan"), None)
    df = spark.createDataFrame([row], "a double, b bigint, c string, d string, e double, f double")
    df = df.withColumn("g", F.lit("2024-05-01 00:00:00").cast("timestamp"))
    df.write.parquet(f"{root}/raw")
    got = read_raw(spark, f"{root}/raw", "a int, b double, c decimal(10,1), d date, e float, f int, g date").first()
    assert repr(got[0:4]) == "(3, 5.0, Decimal('1.5'), datetime.date(2024, 5, 1))"
    assert got["e"] != got["e"] and got["f"] is None and str(got["g"]) == "2024-05-01"


def test_csv_headers_comments_and_paths(spark, tmp_path):
    folder = tmp_path / "my raw+50%"
    folder.mkdir()
    (folder / "a b.csv").write_text("# note, with a comma\nid,'the name'\n1,'x,y'\n")
    (folder / "c+d.csv").write_text("'the name',id\n# between\nz,2\n")
    got = read_raw(spark, str(folder), "id int, `the name` string", "csv", header="true", comment="#", quote="'")
    assert rows(got) == [(1, "x,y"), (2, "z")]
