"""What Spark is asked to do: pruning, pushdown, joins, and files that are left alone."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from palimpsest import (
    create_or_replace,
    delete,
    files,
    insert_row,
    merge,
    read,
    rename_column,
    set_columns,
    snapshots,
    update,
)
from palimpsest.functions.rows import merged_rows
from palimpsest.operators.change import PATH
from palimpsest.sources.data import scan, write
from palimpsest.sources.files import listed, paths
from palimpsest.sources.log import version_at

from .conftest import rows


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def changed(table, orders):
    create_or_replace(orders, table, partition_by=["o_orderpriority"])
    update(table, "o_orderpriority = '1-URGENT'", {"o_totalprice": "o_totalprice * 1.10"})
    return table


def test_pruning_and_pushdown_after_a_change(changed):
    rename_column(changed, "o_totalprice", "price")
    df = read(changed).where("o_orderpriority = '1-URGENT' AND price > 100").select("o_orderkey")
    text = plan(df)
    assert re.search(r"PartitionFilters: \[.*o_orderpriority.* = 1-URGENT", text)
    assert "GreaterThan(o_totalprice,100.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    assert "Batched: true" in text


def test_finding_files_reads_only_the_condition(changed):
    hits = scan(changed, version_at(changed), path_as=PATH).where("o_orderstatus = 'F'").groupBy(PATH).count()
    text = plan(hits)
    assert "ReadSchema: struct<o_orderstatus:string>" in text
    assert "EqualTo(o_orderstatus,F)" in text
    assert "partial_count" in text


def test_whole_folders_are_read_as_folders(changed):
    at = version_at(changed)
    found = paths(changed, listed(changed, at))
    assert len(found) == 5
    assert not any(p.endswith(".parquet") for p in found)


def test_update_adds_files_for_its_partition_only(changed):
    old = {r["file_path"]: r["partition"] for r in files(changed, 1).collect()}
    new = {r["file_path"]: r["partition"] for r in files(changed, 2).collect()}
    assert {new[p] for p in new.keys() - old.keys()} == {"o_orderpriority=1-URGENT"}
    assert {old[p] for p in old.keys() - new.keys()} == {"o_orderpriority=1-URGENT"}


def test_a_hot_partition_is_rewritten_file_by_file(spark, table):
    """A partition in many files: only those with a hit change, the rest is read as before."""
    df = spark.range(0, 8000, 1, 8).select("id", F.lit("hot").alias("p"), F.lit(0).alias("v"))
    create_or_replace(df, table, partition_by=["p"], cluster=False)
    assert files(table).count() == 8
    update(table, "id IN (10, 7990)", {"v": 1})
    summary = snapshots(table).where("version = 2").first()
    assert (summary["removed_files"], summary["removed_records"]) == (2, 2000)
    delete(table, "id >= 2000 AND id < 4500")
    summary = snapshots(table).where("version = 3").first()
    # Two files go without being read again, one is rewritten.
    assert (summary["removed_files"], summary["added_records"]) == (3, 500)
    assert read(table).count() == 5500
    assert read(table).agg(F.sum("v")).first()[0] == 2
    assert len(paths(table, listed(table, version_at(table)))) > 1


def test_a_hot_partition_is_written_by_many_tasks(spark, table):
    """Two thirds of all rows in one partition value: adaptive execution cuts it."""
    hot = F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 9))
    df = spark.range(0, 300_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"), hot.alias("p"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(size)
    spark.conf.set(size, "2MB")
    try:
        create_or_replace(df, table, partition_by=["p"])
    finally:
        spark.conf.set(size, old)
    sizes = F.count(F.lit(1)).alias("n"), F.max("record_count").alias("top"), F.sum("record_count").alias("rows")
    by_part = {r["partition"]: r for r in files(table).groupBy("partition").agg(*sizes).collect()}
    assert by_part["p=hot"]["n"] >= 4
    assert by_part["p=hot"]["top"] < 100_000
    assert {p: r["rows"] for p, r in by_part.items()} == {
        "p=hot": 200_000,
        "p=p2": 33334,
        "p=p5": 33333,
        "p=p8": 33333,
    }


def test_rows_are_not_shuffled_by_update_and_delete(spark, table, orders, monkeypatch):
    create_or_replace(orders, table, partition_by=["o_orderpriority"])
    plans = []

    def seen(t, df, **kw):
        plans.append(plan(df))
        write(t, df, **kw)

    monkeypatch.setattr("palimpsest.operators.write.write", seen)
    update(table, "o_orderstatus = 'O'", {"o_totalprice": 0.0})
    delete(table, "o_orderstatus = 'P'")
    update(table, "o_orderstatus = 'F'", {"o_orderpriority": F.lit("done")})
    assert ["Exchange" in text for text in plans] == [False, False, True]
    assert "REBALANCE_PARTITIONS_BY_COL" in plans[2]


def test_whole_rows_are_shuffled_only_if_one_moves(spark, table, orders, monkeypatch):
    create_or_replace(orders, table, partition_by=["o_orderpriority"])
    plans = []

    def seen(t, df, **kw):
        plans.append(plan(df))
        write(t, df, **kw)

    monkeypatch.setattr("palimpsest.operators.write.write", seen)
    price = orders.withColumn("o_totalprice", F.lit(1.0))
    merge(table, price, "o_orderkey", matched=[set_columns()])
    priority = F.when(F.col("o_orderkey") == 7, "moved").otherwise(F.col("o_orderpriority"))
    moved = price.withColumn("o_orderpriority", priority)
    merge(table, moved, "o_orderkey", matched=[set_columns()])
    assert ["REBALANCE_PARTITIONS_BY_COL" in text for text in plans] == [False, True]
    assert rows(read(table).where("o_orderpriority = 'moved'").select("o_orderkey")) == [(7,)]
    assert read(table).exceptAll(moved).isEmpty()


@pytest.mark.parametrize("broadcast", [True, False])
def test_merge_joins_and_shuffles(spark, table, orders, monkeypatch, broadcast):
    create_or_replace(orders, table, partition_by=["o_orderpriority"])
    source = orders.select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    plans = []

    def seen(t, df, **kw):
        plans.append(plan(df))
        write(t, df, **kw)

    monkeypatch.setattr("palimpsest.operators.write.write", seen)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        merge(table, source, "o_orderkey", matched=[set_columns({"o_orderstatus": "s.o_orderstatus"})])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert rows(read(table).select("o_orderstatus").distinct()) == [("X",)]
    assert "CartesianProduct" not in plans[0] and "BroadcastNestedLoopJoin" not in plans[0]
    if broadcast:
        assert "BroadcastHashJoin LeftOuter BuildRight" in plans[0]
        assert "hashpartitioning" not in plans[0]
    else:
        assert "SortMergeJoin LeftOuter" in plans[0]
        assert "REBALANCE_PARTITIONS_BY_COL" in plans[0]


def test_a_hot_key_is_split(spark, table):
    """A third of the target shares one key: the joins that meet it are cut by adaptive execution."""
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k")
    noise = F.sha2(F.col("id").cast("string"), 256).alias("s")
    create_or_replace(spark.range(0, 300_000, 1, 8).select(hot, F.lit(0).alias("v"), noise), table)
    source = spark.range(0, 300_000, 1, 4).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    source.write.parquet(table.path + "/source")
    source = spark.read.parquet(table.path + "/source")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.shuffle.partitions": "32",
    }
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        at = version_at(table)
        found = scan(table, at, path_as=PATH).select("k", PATH).join(source.select("k"), "k", "left_semi")
        found = found.groupBy(PATH).agg(F.count(F.lit(1)).alias("n"))
        assert sum(r["n"] for r in found.collect()) == 300_000
        assert "SortMergeJoin(skew=true)" in plan(found)
        changed = merged_rows(scan(table, at), source, F.expr("t.k = s.k"), [set_columns({"v": "s.v"})], [])
        changed = changed.groupBy("v").agg(F.countDistinct("s"))
        assert rows(changed) == [(1, 300_000)]
        assert "SortMergeJoin(skew=true)" in plan(changed)
        merge(table, source, "k", matched=[set_columns({"v": "s.v"})], not_matched=[insert_row({"k": "s.k", "v": "s.v"})])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # Keys 0, 3, 6, ... but 7 itself were nobody's and are inserted.
    assert read(table).where("v = 1").count() == 300_000 + 100_000
    assert read(table).where("k = 7").count() == 100_001
