"""Cases in which rows could get lost or changed silently, and plans that must stay small."""

import time

import pytest
from pyspark.sql import functions as F

from palimpsest import (
    Checks,
    Table,
    append,
    create_or_replace,
    delete,
    files,
    insert_row,
    merge,
    read,
    read_raw,
    register_views,
    remove_row,
    set_columns,
    snapshots,
    sql,
    update,
)
from palimpsest.operators.merge import RepeatedSourceKey
from palimpsest.plans.batch import _check
from palimpsest.functions.checks import CheckFailed
from palimpsest.sources.files import UnlistedFile, listed, paths, touching
from palimpsest.sources.log import version_at

from .conftest import rows


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder)


@pytest.mark.parametrize(
    "kind, text",
    [
        ("json", '{"a": 1, "b": 2.0}\n{"a": 1, \n'),
        ("json", '{"a": "x", "b": 2.0}\n'),
        ("csv", "a,b\n1,2.0\n2\n"),
        ("csv", "a,b\n3,4,5,6\n"),
        ("csv", "a,b\nx,4\n"),
        ("csv", "a,c\n1,2\n"),
    ],
)
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_raw_files_fail_the_job(spark, tmp_path, kind, text, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception):  # noqa: B017  a Spark error of one kind or another
            read_raw(spark, put(tmp_path, f"f.{kind}", text), "a int, b double", kind, header="true").collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_raw_headers_in_any_order(spark, tmp_path):
    put(tmp_path, "1.csv", "a,b,c\n1,2.5,x\n")
    put(tmp_path, "2.csv", "b,\"a\"\n4.5,3\n")
    put(tmp_path, "3.csv", "")
    assert rows(read_raw(spark, str(tmp_path), "a int, b double", "csv", header="true")) == [(1, 2.5), (3, 4.5)]
    loose = read_raw(spark, put(tmp_path, "4.csv", "a,b\n5\n"), "a int, b double", "csv", header="true", mode="PERMISSIVE")
    assert (5, None) in rows(loose)


def test_opening_json_runs_no_job(spark, tmp_path):
    path = put(tmp_path, "f.json", '{"a": 1}\n')
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    df = read_raw(spark, path, "a int", "json")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert rows(df) == [(1,)]


def test_values_that_do_not_fit_fail_whatever_the_setting(spark, table):
    create_or_replace(spark.createDataFrame([(1, 1)], "id int, v int"), table)
    big = spark.createDataFrame([(1, 3_000_000_000)], "id int, v bigint")
    text = spark.createDataFrame([(1, "x")], "id int, v string")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        for change in (
            lambda: update(table, "id = 1", {"v": F.lit(3_000_000_000)}),
            lambda: append(big, table),
            lambda: append(text, table),
            lambda: merge(table, big, "id", matched=[set_columns()]),
            lambda: merge(table, text, "id", matched=[set_columns({"v": "s.v"})]),
        ):
            with pytest.raises(Exception, match="not a int"):
                change()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert rows(read(table)) == [(1, 1)]


@pytest.mark.parametrize("threshold", ["10m", "-1", "1pb"])
def test_nan_keys(spark, table, threshold):
    nan = float("nan")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        create_or_replace(spark.createDataFrame([(1.0, 1), (nan, 2), (None, 3)], "k double, v int").coalesce(1), table)
        source = spark.createDataFrame([(1.0, 10), (nan, 20), (None, 30)], "k double, v int")
        merge(table, source, "k", matched=[set_columns()], not_matched=[insert_row()])
        want = [(1.0, 10), (nan, 20), (None, 3), (None, 30)]
        assert [repr(r) for r in rows(read(table))] == sorted(map(repr, want))
        with pytest.raises(RepeatedSourceKey):
            merge(table, source.union(source.where("isnan(k)")), "k", matched=[set_columns()])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_reads_after_a_small_change_name_few_paths(spark, table):
    n = 300
    df = spark.range(0, 3000, 1, n).withColumn("v", F.lit(0))
    create_or_replace(df, table)
    assert files(table).count() == n

    def opened():
        start = time.perf_counter()
        read(table)
        return time.perf_counter() - start

    opened()
    before = opened()
    update(table, "id = 17", {"v": 1})
    delete(table, "id = 2500")
    reads = paths(table, listed(table, version_at(table)))
    assert len(reads) + len(reads.excluded) <= 2 * n**0.5
    assert opened() <= 2 * before + 0.5
    assert read(table).agg(F.count("id"), F.sum("v")).first() == (2999, 1)
    assert read(table, 1).agg(F.count("id"), F.sum("v")).first() == (3000, 0)
    assert read(table, 2).count() == 3000
    delete(table, "id < 2000")  # most files of the folder are dead now: the others are named
    assert read(table).count() == 999
    update(table, "id % 2 = 0", {"v": 2})
    assert read(table).agg(F.sum("v")).first()[0] == 2 * read(table).where("id % 2 = 0").count()


def test_merge_rewrites_only_files_where_a_clause_applies(spark, table):
    create_or_replace(spark.range(0, 8000, 1, 8).withColumn("v", F.col("id")), table)

    def rewritten():
        return snapshots(table).orderBy(F.desc("version")).first()["removed_files"]

    same = spark.range(8000).withColumn("v", F.col("id"))
    merge(table, same.where("id <> 4321"), "id", not_matched_by_source=[remove_row()])
    assert rewritten() == 1 and read(table).count() == 7999
    merge(table, same, "id", matched=[set_columns({"v": "s.v"}, "s.v <> t.v")])
    assert rewritten() == 0
    changed = same.withColumn("v", F.when(F.col("id") == 5, -1).otherwise(F.col("v")))
    merge(
        table,
        changed,
        "id",
        matched=[set_columns({"v": "s.v"}, "s.v <> t.v")],
        not_matched=[insert_row()],
        not_matched_by_source=[remove_row("t.v < 0")],
    )
    assert rewritten() == 1 and read(table).count() == 8000
    assert rows(read(table).where("v <> id")) == [(5, -1)]


def test_partitioned_writes_are_clustered_without_adaptive_execution(spark, root):
    df = spark.range(0, 4000, 1, 40).withColumn("p", F.col("id") % 20).withColumn("hot", F.lit("one"))
    counts = {}
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            for by in ("p", "hot"):
                table = Table(spark, root, "datalake", f"{by}_{adaptive}")
                create_or_replace(df, table, partition_by=[by])
                counts[by, adaptive] = files(table).count()
                assert read(table).count() == 4000
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert counts["p", "false"] <= 5 * counts["p", "true"]
    assert counts["hot", "false"] > 1


def test_staged_rows_are_gone_after_a_statement(spark, table):
    table = Table(spark, table.root, "datalake", "staged_rows")
    create_or_replace(spark.range(100).withColumn("v", F.lit(0)), table)
    source = spark.range(50, 150).withColumn("v", F.lit(1))
    merge(table, source, "id", matched=[set_columns()], not_matched=[insert_row()])
    update(table, "id = 1", {"v": 2})
    delete(table, "id = 2")
    shared = spark.conf.get("spark.checkpoint.dir")
    left = spark.read.option("recursiveFileLookup", "true").schema("x int").parquet(f"{shared}/datalake/staged_rows")
    assert left.count() == 0
    assert read(table).count() == 149


def test_conditions_on_the_clock_are_refused(spark, table):
    create_or_replace(spark.range(3).withColumn("t", F.current_timestamp()), table)
    for c in ("t > current_timestamp()", "t < now() AND id = 1", F.col("t") > F.current_date()):
        with pytest.raises(ValueError, match="clock"):
            delete(table, c)
    delete(table, "id = 1 AND concat(id, 'now() current_date()') <> 'x'")
    assert read(table).count() == 2


def test_a_touched_file_must_be_listed(spark, table):
    create_or_replace(spark.range(3), table)
    stranger = spark.createDataFrame([("write_id=x/part-0", 1)], "name string, matched bigint")
    with pytest.raises(UnlistedFile):
        paths(table, touching(listed(table, version_at(table)), stranger), F.col("matched").isNotNull())


def test_views_of_two_namespaces(spark, root):
    for n, ns in enumerate(("a", "b")):
        create_or_replace(spark.range(n + 1), Table(spark, root, ns, "t"))
        create_or_replace(spark.range(9), Table(spark, root, ns, "unused"))
        assert register_views(spark, root, ns, names=["t"], prefix=f"{ns}_") == ["t"]
    assert spark.sql("SELECT count(*) FROM a_t CROSS JOIN b_t").first()[0] == 2
    assert sql(spark, root, "b", "SELECT count(*) FROM b_t", prefix="b_").first()[0] == 2
    assert not spark.catalog.tableExists("b_unused")


def test_compression_and_schema_check(spark, table):
    df = spark.range(10).withColumn("v", F.lit("x"))
    create_or_replace(df, table, compression="snappy")
    update(table, "id = 1", {"v": F.lit("y")})
    assert all(".snappy." in r["file_path"] for r in files(table).collect())
    assert _check(read(table), Checks(schema="id bigint, v string")) == 10
    with pytest.raises(CheckFailed):
        _check(read(table), Checks(schema="id bigint"))
