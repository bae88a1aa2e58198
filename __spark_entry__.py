"""

Every query makes its tables from the given ones, whole, applies operators to
them and returns what the table then holds. Literal rows, and the list of Spark's
catalogs alone, read no given table; ``tests/`` covers those.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import (
    Checks,
    Delete,
    Table,
    Update,
    add_column,
    append,
    changes_between,
    compact,
    count_rows,
    create_namespace,
    create_or_replace,
    delete,
    drift,
    drop_column,
    files,
    history,
    ingest,
    insert_row,
    list_catalogs,
    list_tables,
    merge,
    merge_where,
    read,
    read_raw,
    register_metadata_views,
    register_views,
    remove_row,
    rename_column,
    repeated_keys,
    run_batch,
    run_sql,
    set_columns,
    snapshots,
    sql,
    store_profile,
    update,
    validate,
    validate_drift,
    widen_column,
)

try:
    import corpus_pipeline
    import palimpsest.llm.queries as llm_queries
except ImportError:  # the two come and go together
    corpus_pipeline = llm_queries = None

NAMESPACE = "datalake"

ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string"
)
URGENT = "o_orderpriority = '1-URGENT'"
RAISE = {"o_totalprice": "o_totalprice * 1.10"}
FINISHED = "o_orderstatus = 'F'"
DRIFT_QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _root(spark: SparkSession) -> str:
    """A new folder for the tables of one run, in the shared folder the cluster names, or in its warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"


def _table(spark: SparkSession, name: str = "orders", root: str | None = None) -> Table:
    return Table(spark, root or _root(spark), NAMESPACE, name)


def _given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, partition_by: tuple[str, ...] = ("o_orderpriority",)) -> Table:
    table = _table(spark)
    create_or_replace(_given(spark, sf_dir, "orders"), table, partition_by=partition_by)
    return table


def _changed_orders(spark: SparkSession, sf_dir: str) -> Table:
    """Three versions: created, updated, rows deleted."""
    table = _orders(spark, sf_dir)
    update(table, URGENT, RAISE)
    delete(table, FINISHED)
    return table


def table_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(_orders(spark, sf_dir, partition_by=()))


def table_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    create_or_replace(read(table).where("o_orderstatus = 'O'"), table)
    return read(table)


def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    append(_given(spark, sf_dir, "orders").drop("o_orderdate"), table)
    return read(table)


def orc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark)
    create_or_replace(_given(spark, sf_dir, "orders"), table, format="orc", partition_by=["o_orderpriority"])
    return read(table)


def array_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, "embeddings")
    create_or_replace(_given(spark, sf_dir, "embeddings"), table)
    update(table, "label = 0", {"label": -1})
    return read(table).select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", "label", "pos", F.col("x").cast("double").alias("x")
    )


def raw_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, "lineitem")
    declared = "l_orderkey bigint, l_linenumber int, l_quantity double, l_shipdate date"
    create_or_replace(read_raw(spark, f"{sf_dir}/lineitem.parquet", declared), table)
    return read(table).withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


def raw_csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files whose headers have the columns in different orders."""
    orders, folder = _given(spark, sf_dir, "orders"), f"{_root(spark)}/raw"
    for i, rows in enumerate((orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 <> 0"))):
        rows = rows.select(orders.columns if i == 0 else orders.columns[::-1])
        rows.write.mode("append").option("header", "true").csv(folder)
    table = _table(spark)
    create_or_replace(read_raw(spark, folder, ORDERS, "csv", header="true"), table)
    return read(table)


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{_root(spark)}/raw"
    _given(spark, sf_dir, "orders").write.json(folder)
    table = _table(spark)
    create_or_replace(read_raw(spark, folder, ORDERS, "json"), table)
    return read(table)


def partitioned_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(_orders(spark, sf_dir)).where("o_orderpriority = '2-HIGH'").select("o_orderkey", "o_totalprice")


def row_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    update(table, URGENT, RAISE)
    return read(table)


def row_update_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    update(table, FINISHED, {"o_orderpriority": F.lit("0-DONE"), "o_orderstatus": "substr(o_orderpriority, 1, 1)"})
    return read(table)


def row_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    delete(table, FINISHED)
    return read(table)


def delete_scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few rows of every file are deleted by position, twice, and no data file is written; the first version is as it was."""
    table = _table(spark)
    create_or_replace(_given(spark, sf_dir, "orders").repartition(8, "o_orderkey"), table, cluster=False)
    delete(table, "o_orderkey % 100 = 7", by_position=0.1)
    delete(table, "o_custkey % 100 = 9", by_position=0.1)
    now = read(table).withColumn("version", F.lit("now"))
    return now.unionByName(read(table, version=1).withColumn("version", F.lit("first")))


def update_scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that list the old rows as deleted and write the new ones only, then a delete that meets both."""
    table = _table(spark)
    create_or_replace(_given(spark, sf_dir, "orders"), table, partition_by=["o_orderstatus"])
    update(table, "o_orderkey % 50 = 3", RAISE, by_position=0.1)
    delete(table, "o_orderkey % 150 = 53", by_position=0.1)
    return read(table)


def row_delete_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark)
    priority = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    rows = _given(spark, sf_dir, "orders").withColumn("o_orderpriority", priority)
    create_or_replace(rows, table, partition_by=["o_orderpriority"])
    delete(table, "o_orderpriority = '5-LOW'")
    return read(table)


def text_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, "documents")
    create_or_replace(_given(spark, sf_dir, "documents"), table, partition_by=["lang"])
    update(table, "text LIKE '%the%'", {"n_chars": F.length("text"), "source": F.upper("source")})
    return read(table)


def batch_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = run_batch(
        spark,
        "2024-05-01",
        f"{sf_dir}/orders.parquet",
        _table(spark),
        ORDERS,
        partition_by=["o_orderpriority"],
        changes=[Update(URGENT, RAISE), Delete(FINISHED)],
        loaded=Checks(min_rows=1, not_null=["o_orderkey"], unique=["o_orderkey"]),
        final=Checks(not_null=["o_orderkey"], unique=["o_orderkey"]),
    )
    return result.current


def as_of_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(_changed_orders(spark, sf_dir), version=1)


def as_of_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(_changed_orders(spark, sf_dir), version=2)


def history_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _changed_orders(spark, sf_dir)
    return history(table).join(snapshots(table).select("version", "total_records"), "version").select(
        "version", F.coalesce("parent", F.lit(0)).alias("parent"), "operation", "is_current_ancestor", "total_records"
    )


def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in all, added and removed, of a table that is made, changed, cut and replaced."""
    table = _changed_orders(spark, sf_dir)
    create_or_replace(_given(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), table)
    # Rows of a rewritten file count as removed and as added: only the difference is fixed.
    changed = F.col("operation").isin("update", "delete")
    return snapshots(table).select(
        "version",
        "operation",
        "total_records",
        (F.col("added_records") - F.col("removed_records")).alias("more_records"),
        F.when(changed, 0).otherwise(F.col("added_records")).alias("added_records"),
        F.when(changed, 0).otherwise(F.col("removed_records")).alias("removed_records"),
    )


def files_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.substring_index("partition", "=", -1).alias("part")
    return files(_orders(spark, sf_dir)).groupBy(part).agg(F.sum("record_count").alias("record_count"))


def _yesterday(spark: SparkSession, sf_dir: str) -> Table:
    """Orders without those in state P, which the next extract brings."""
    table = _table(spark)
    create_or_replace(
        _given(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), table, partition_by=["o_orderpriority"]
    )
    return table


def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next extract: orders not in state F, at new prices."""
    return (
        _given(spark, sf_dir, "orders")
        .where("o_orderstatus <> 'F'")
        .withColumn("o_totalprice", F.expr("o_totalprice * 1.10"))
    )


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _yesterday(spark, sf_dir)
    merge(table, _extract(spark, sf_dir), "o_orderkey", matched=[set_columns()], not_matched=[insert_row()])
    return read(table)


def merge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _yesterday(spark, sf_dir)
    values = {c: f"s.{c}" for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")}
    merge(table, _extract(spark, sf_dir), "o_orderkey", not_matched=[insert_row(values)])
    return read(table)


def merge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    returned = _given(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    merge(table, returned, {"o_orderkey": "l_orderkey"}, matched=[remove_row()])
    return read(table)


def merge_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _yesterday(spark, sf_dir)
    merge(
        table,
        _extract(spark, sf_dir),
        "o_orderkey",
        matched=[set_columns()],
        not_matched=[insert_row()],
        not_matched_by_source=[remove_row()],
    )
    return read(table)


def merge_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with conditions: the first that is TRUE applies, else the row stays."""
    table = _orders(spark, sf_dir)
    lines = (
        _given(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.max("l_extendedprice").alias("top_price"))
    )
    merge(
        table,
        lines,
        {"o_orderkey": "k"},
        matched=[
            remove_row("s.n_lines >= 7 AND t.o_orderstatus = 'F'"),
            set_columns({"o_totalprice": "s.top_price"}, "s.n_lines > 2"),
            set_columns({"o_orderstatus": F.lit("S")}, "s.top_price < t.o_totalprice"),
        ],
        not_matched_by_source=[set_columns({"o_orderstatus": F.lit("E")}, "t.o_orderstatus = 'O'"), remove_row()],
    )
    return read(table)


def merge_repeated_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source row may change many target rows."""
    table = _table(spark, "lineitem")
    create_or_replace(_given(spark, sf_dir, "lineitem"), table, partition_by=["l_returnflag"])
    done = _given(spark, sf_dir, "orders").where(FINISHED).select("o_orderkey", "o_custkey")
    merge(
        table,
        done,
        {"l_orderkey": "o_orderkey"},
        matched=[set_columns({"l_linestatus": F.lit("D"), "l_suppkey": "s.o_custkey"})],
    )
    return read(table)


def merge_nan_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN is a key like any other."""
    key = F.when(F.col("o_orderkey") == 1, F.lit(float("nan"))).otherwise(F.col("o_orderkey").cast("double"))
    table = _table(spark)
    create_or_replace(_given(spark, sf_dir, "orders").withColumn("k", key), table, partition_by=["o_orderpriority"])
    changes = _extract(spark, sf_dir).unionByName(
        _given(spark, sf_dir, "orders").where("o_orderkey = 1 AND o_orderstatus = 'F'")
    )
    changes = changes.withColumn("k", key).withColumn("o_orderstatus", F.lit("N"))
    merge(table, changes, "k", matched=[set_columns()], not_matched=[insert_row()])
    return read(table).withColumn("k", F.when(F.isnan("k"), -1.0).otherwise(F.col("k")))


def alter_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    add_column(table, "bonus", "double")
    return read(table)


def alter_add_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped and added again: the new column does not show the old values."""
    table = _orders(spark, sf_dir)
    drop_column(table, "o_totalprice")
    add_column(table, "o_totalprice", "double")
    update(table, URGENT, {"o_totalprice": "o_custkey + 0.5"})
    return read(table)


def alter_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir, partition_by=())
    drop_column(table, "o_orderpriority")
    return read(table)


def alter_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    rename_column(table, "o_totalprice", "price")
    rename_column(table, "o_orderpriority", "priority")
    update(table, "priority = '1-URGENT'", {"price": "price * 1.10"})
    return read(table)


def alter_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark)
    narrow = _given(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("int"))
    create_or_replace(narrow, table)
    widen_column(table, "k", "bigint")
    return read(table)


def validate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(_orders(spark, sf_dir))
    validate(df, min_rows=1, not_null=["o_orderkey", "o_orderpriority"], unique=["o_orderkey"])
    return count_rows(df)


def validate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that make a uniqueness check fail."""
    table = _table(spark, "lineitem")
    create_or_replace(_given(spark, sf_dir, "lineitem"), table)
    return repeated_keys(read(table), ["l_orderkey", "l_linenumber"])


def namespace_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's tables in a new namespace, with their row counts."""
    root = _root(spark)
    create_namespace(spark, NAMESPACE, root)
    for name in ("orders", "customer"):
        create_or_replace(_given(spark, sf_dir, name), _table(spark, name, root))
    catalog = next(c for c in list_catalogs(spark) if c == "spark_catalog")
    result = None
    for name in list_tables(spark, root, NAMESPACE):
        one = count_rows(read(_table(spark, name, root))).select(
            F.lit(catalog).alias("catalog"), F.lit(NAMESPACE).alias("namespace"), F.lit(name).alias("name"), "total"
        )
        result = one if result is None else result.unionByName(one)
    return result


def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    create_or_replace(_given(spark, sf_dir, "customer"), _table(spark, "customer", table.root))
    return sql(
        spark,
        table.root,
        NAMESPACE,
        "SELECT c_mktsegment, o_orderstatus, count(*) AS n, max(o_totalprice) AS top"
        " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus",
    )


def adhoc_sql_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _changed_orders(spark, sf_dir)
    register_views(spark, table.root, NAMESPACE, versions={"orders": 1})
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")


def adhoc_sql_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and data files through SQL."""
    table = _changed_orders(spark, sf_dir)
    register_metadata_views(table)
    return spark.sql(
        "SELECT h.version, h.operation, f.record_count, f.positive FROM orders_history h CROSS JOIN"
        " (SELECT sum(record_count) AS record_count, bool_and(file_size_in_bytes > 0) AS positive"
        "  FROM orders_files WHERE file_path LIKE '%/data/%') f"
    )


def sql_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    text = "UPDATE datalake.orders AS o SET o.o_totalprice = o.o_totalprice * 1.10 WHERE o.o_orderpriority = '1-URGENT'"
    run_sql(spark, table.root, NAMESPACE, text)
    return read(table)


def sql_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    create_or_replace(_given(spark, sf_dir, "customer"), _table(spark, "customer", table.root))
    text = "DELETE FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
    run_sql(spark, table.root, NAMESPACE, text)
    return read(table)


def sql_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir)
    create_or_replace(_given(spark, sf_dir, "lineitem"), _table(spark, "lineitem", table.root))
    run_sql(
        spark,
        table.root,
        NAMESPACE,
        """MERGE INTO orders AS o
           USING (SELECT l_orderkey AS k, count(*) AS n, max(l_extendedprice) AS top FROM lineitem GROUP BY l_orderkey) AS l
           ON o.o_orderkey = l.k
           WHEN MATCHED AND l.n >= 6 THEN DELETE
           WHEN MATCHED AND l.top < o.o_totalprice THEN UPDATE SET o.o_totalprice = l.top, o_orderstatus = 'M'
           WHEN NOT MATCHED THEN INSERT (o_orderkey, o_totalprice, o_orderpriority) VALUES (l.k, l.top, '9-NEW')
           WHEN NOT MATCHED BY SOURCE THEN DELETE""",
    )
    return read(table)


def sql_version_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two changes did, by versions named in one query."""
    table = _changed_orders(spark, sf_dir)
    return run_sql(
        spark,
        table.root,
        NAMESPACE,
        """WITH was AS (SELECT * FROM datalake.orders VERSION AS OF 1)
           SELECT was.o_orderkey, orders.o_totalprice - was.o_totalprice > 0 AS raised, orders.o_orderkey IS NULL AS gone
           FROM was LEFT JOIN orders FOR SYSTEM_VERSION AS OF 3 ON was.o_orderkey = orders.o_orderkey""",
    )


def merge_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders meet the price band of their priority that they lie in; some bands are left out."""
    table = _orders(spark, sf_dir)
    bands = (
        _given(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", F.floor(F.col("o_totalprice") / 10000).alias("band"))
        .agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("band % 3 <> 0")
    )
    merge_where(
        table,
        bands,
        "t.o_totalprice BETWEEN s.low AND s.high AND t.o_orderpriority = s.o_orderpriority",
        matched=[remove_row("s.n = 1"), set_columns({"o_totalprice": "s.high", "o_custkey": "s.n"})],
        not_matched_by_source=[set_columns({"o_orderstatus": F.lit("U")}, "t.o_orderstatus = 'P'")],
    )
    return read(table)


def merge_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders meet the month they were made in, by two inequalities and no key; months to come are inserted."""
    table = _orders(spark, sf_dir, partition_by=())
    months = _given(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("start")).distinct()
    months = months.unionByName(months.agg(F.add_months(F.max("start"), 1).cast("timestamp").alias("start")))
    months = months.select(F.col("start").cast("timestamp_ntz").alias("start"))
    months = months.withColumn("end", F.expr("start + INTERVAL 1 MONTH")).where("month(start) <> 2")
    merge_where(
        table,
        months,
        "t.o_orderdate >= s.start AND t.o_orderdate < s.end",
        matched=[set_columns({"o_custkey": "year(s.start) * 100 + month(s.start)"})],
        not_matched=[insert_row({"o_orderkey": F.lit(-1), "o_orderstatus": F.lit("N")})],
    )
    return read(table)


def _ranged_orders(spark: SparkSession, sf_dir: str) -> Table:
    """In files by key, with the bounds of three columns kept."""
    table = _table(spark)
    rows = _given(spark, sf_dir, "orders").repartitionByRange(16, "o_orderkey")
    create_or_replace(rows, table, ranges=["o_orderkey", "o_orderdate", "o_orderpriority"])
    return table


def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _ranged_orders(spark, sf_dir)
    return read(table, where="o_orderkey BETWEEN 101 AND 400 AND o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderkey = 7")


def range_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _ranged_orders(spark, sf_dir)
    update(table, "o_orderkey < 500 AND o_orderstatus <> 'F'", {"o_totalprice": 0.0})
    delete(table, "o_orderkey >= 900")
    return read(table)


def file_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of all files together."""
    bounds = F.col("bounds")["o_orderkey"]
    return files(_ranged_orders(spark, sf_dir)).agg(
        F.min(bounds["low"].cast("bigint")).alias("low"),
        F.max(bounds["high"].cast("bigint")).alias("high"),
        F.sum(bounds["nulls"]).alias("nulls"),
        F.sum("record_count").alias("record_count"),
    )


def curve_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in files along a curve through two columns, asked for by either."""
    table = _table(spark)
    create_or_replace(_given(spark, sf_dir, "orders"), table, zorder=["o_custkey", "o_totalprice"])
    by_customer = read(table, where="o_custkey BETWEEN 10 AND 30").select("o_orderkey", F.lit("customer").alias("by"))
    return by_customer.unionByName(read(table, where="o_totalprice > 400000").select("o_orderkey", F.lit("price").alias("by")))


def feed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an update, a delete and a merge did together; rows that files were rewritten for are not in it."""
    table = _changed_orders(spark, sf_dir)
    changes = _given(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("N"))
    merge(table, changes, "o_orderkey", matched=[set_columns()], not_matched=[insert_row()])
    return changes_between(table, 1, 4)


def compact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small files, some of them replaced, become a few: the rows are the same, before and after."""
    table = _table(spark)
    create_or_replace(_given(spark, sf_dir, "orders").repartition(20), table, cluster=False)
    append(_given(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), table)
    update(table, "o_orderkey % 50 = 0", RAISE)
    compact(table)
    now = read(table).withColumn("version", F.lit("now"))
    return now.unionByName(read(table, version=2).withColumn("version", F.lit("before")))


def raw_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files land in three lots, the second one twice taken for: every row is there once."""
    orders, folder = _given(spark, sf_dir, "orders"), f"{_root(spark)}/landing"
    table = _table(spark)
    for lot in range(3):
        orders.where(f"o_orderkey % 3 = {lot}").write.mode("append").json(folder)
        ingest(table, folder, ORDERS, "json", pattern="*.json", partition_by=["o_orderpriority"])
        if lot == 1:
            ingest(table, folder, ORDERS, "json", pattern="*.json")
    return read(table)


def drift_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of two versions against the rows: what they say is within their stated errors."""
    table = _orders(spark, sf_dir)
    store_profile(table, ["o_totalprice", "o_orderdate"], ["o_custkey", "o_orderkey"])
    append(_given(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumn("o_custkey", -F.col("o_custkey")), table)
    store_profile(table, ["o_totalprice", "o_orderdate"], ["o_custkey", "o_orderkey"])  # reads the appended files only
    validate_drift(table, 1, 2, max_shift={"o_totalprice": 0.1}, min_overlap={"o_orderkey": 0.99})
    said, rows = drift(table, 1, 2), read(table)
    shares = said.where("column = 'o_totalprice'").select(
        "rows_old", "rows_new", F.posexplode(F.arrays_zip(F.col("quantiles_new").alias("value"), F.lit(DRIFT_QUANTILES).alias("share")))
    )
    below = rows.join(F.broadcast(shares), F.col("o_totalprice") <= F.col("col.value")).groupBy("col.share", "rows_old", "rows_new")
    off = F.abs(F.count(F.lit(1)) / F.first("rows_new") - F.col("share"))
    quantiles = below.agg((off <= 0.02).alias("within")).select(
        F.lit("o_totalprice").alias("column"), "rows_old", "rows_new", F.col("share"), "within"
    )
    exact = rows.agg(F.count_distinct("o_custkey").alias("o_custkey"), F.count_distinct("o_orderkey").alias("o_orderkey"))
    exact = exact.select(F.expr("stack(2, 'o_custkey', o_custkey, 'o_orderkey', o_orderkey) AS (column, n)"))
    keys = said.join(exact, "column").select(
        "column", "rows_old", "rows_new", F.lit(None).cast("double").alias("share"), (F.abs(F.col("distinct_new") / F.col("n") - 1) < 0.04).alias("within")
    )
    return quantiles.unionByName(keys)


def batch_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that fails at its last change goes on there: no version is made twice."""
    table = _table(spark)
    steps = {"partition_by": ["o_orderpriority"], "loaded": Checks(min_rows=1), "resume": True}
    raw = f"{sf_dir}/orders.parquet"
    broken = Delete("CASE WHEN o_orderstatus = 'F' THEN raise_error('not now') ELSE false END")
    try:
        run_batch(spark, "2024-05-01", raw, table, ORDERS, changes=[Update(URGENT, RAISE), broken], **steps)
    except SparkRuntimeException:
        pass
    result = run_batch(spark, "2024-05-01", raw, table, ORDERS, changes=[Update(URGENT, RAISE), Delete(FINISHED)], **steps)
    return result.current.withColumn("version", F.lit(result.last_version))


def entry(spark: SparkSession) -> DataFrame:
    return batch_flow(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per query, by name."""
    out = {
        q.__name__: q
        for q in (
            table_create,
            table_replace,
            table_append,
            orc_roundtrip,
            array_column,
            raw_ingest,
            raw_csv_headers,
            raw_json,
            partitioned_filter,
            row_update,
            row_update_moves,
            row_delete,
            row_delete_nulls,
            text_update,
            batch_flow,
            as_of_first,
            as_of_middle,
            history_ops,
            snapshot_summary,
            files_by_partition,
            merge_upsert,
            merge_insert,
            merge_delete,
            merge_sync,
            merge_clauses,
            merge_repeated_target,
            merge_nan_key,
            alter_add,
            alter_add_update,
            alter_drop,
            alter_rename,
            alter_widen,
            validate_count,
            validate_unique,
            namespace_create,
            adhoc_sql,
            adhoc_sql_version,
            adhoc_sql_metadata,
            sql_update,
            sql_delete,
            sql_merge,
            sql_version_as_of,
            merge_range,
            merge_window,
            range_read,
            range_update,
            file_bounds,
            curve_read,
            feed_changes,
            compact_files,
            delete_scattered,
            update_scattered,
            raw_incremental,
            drift_within_error,
            batch_resume,
        )
    }
    if llm_queries is not None:
        out |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return out


_RAISED = "CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 1.10 ELSE o_totalprice END"
_EXTRACT = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 1.10 AS o_totalprice, o_orderdate, o_orderpriority"
    " FROM orders WHERE o_orderstatus <> 'F'"
)


def oracle_sql() -> dict[str, str]:
    """For each query that SQL can express, SQL for DuckDB over the given tables that gives the same rows."""
    out = {
        "table_create": "SELECT * FROM orders",
        "table_replace": "SELECT * FROM orders WHERE o_orderstatus = 'O'",
        "table_append": """
            SELECT * FROM orders UNION ALL
            SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, NULL, o_orderpriority FROM orders""",
        "orc_roundtrip": "SELECT * FROM orders",
        "array_column": """
            SELECT vec_id, CASE WHEN label = 0 THEN CAST(-1 AS INTEGER) ELSE label END AS label,
                   CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS x
            FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
        "raw_ingest": """
            SELECT l_orderkey, l_linenumber, l_quantity, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate
            FROM lineitem""",
        "raw_csv_headers": "SELECT * FROM orders",
        "raw_json": "SELECT * FROM orders",
        "partitioned_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH'",
        "row_update": f"""
            SELECT o_orderkey, o_custkey, o_orderstatus, {_RAISED} AS o_totalprice, o_orderdate, o_orderpriority
            FROM orders""",
        "row_update_moves": """
            SELECT o_orderkey, o_custkey,
                   CASE WHEN o_orderstatus = 'F' THEN substr(o_orderpriority, 1, 1) ELSE o_orderstatus END
                       AS o_orderstatus,
                   o_totalprice, o_orderdate,
                   CASE WHEN o_orderstatus = 'F' THEN '0-DONE' ELSE o_orderpriority END AS o_orderpriority
            FROM orders""",
        "row_delete": "SELECT * FROM orders WHERE (o_orderstatus = 'F') IS NOT TRUE",
        "row_delete_nulls": """
            SELECT * FROM (SELECT * REPLACE (CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority)
                           FROM orders)
            WHERE (o_orderpriority = '5-LOW') IS NOT TRUE""",
        "text_update": """
            SELECT doc_id, text, lang,
                   CASE WHEN text LIKE '%the%' THEN upper(source) ELSE source END AS source,
                   CASE WHEN text LIKE '%the%' THEN CAST(length(text) AS BIGINT) ELSE n_chars END AS n_chars
            FROM documents""",
        "batch_flow": f"""
            SELECT * REPLACE ({_RAISED} AS o_totalprice) FROM orders WHERE (o_orderstatus = 'F') IS NOT TRUE""",
        "as_of_first": "SELECT * FROM orders",
        "as_of_middle": f"SELECT * REPLACE ({_RAISED} AS o_totalprice) FROM orders",
        "history_ops": """
            SELECT version, parent, operation, TRUE AS is_current_ancestor,
                   CASE WHEN version < 3 THEN (SELECT count(*) FROM orders)
                        ELSE (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') END AS total_records
            FROM (VALUES (1, 0, 'create'), (2, 1, 'update'), (3, 2, 'delete'))
                 t(version, parent, operation)""",
        "snapshot_summary": """
            WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE o_orderstatus <> 'F') AS b,
                              count(*) FILTER (WHERE o_orderstatus = 'O') AS c FROM orders)
            SELECT 1 AS version, 'create' AS operation, a AS total_records, a AS more_records, a AS added_records,
                   0 AS removed_records FROM n
            UNION ALL SELECT 2, 'update', a, 0, 0, 0 FROM n
            UNION ALL SELECT 3, 'delete', b, b - a, 0, 0 FROM n
            UNION ALL SELECT 4, 'replace', c, c - b, c, b FROM n""",
        "files_by_partition": """
            SELECT o_orderpriority AS part, count(*) AS record_count FROM orders GROUP BY o_orderpriority""",
        "merge_upsert": f"{_EXTRACT} UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'",
        "merge_insert": """
            SELECT * FROM orders WHERE o_orderstatus <> 'P'
            UNION ALL
            SELECT o_orderkey, o_custkey, NULL, o_totalprice * 1.10, NULL, o_orderpriority
            FROM orders WHERE o_orderstatus = 'P'""",
        "merge_delete": """
            SELECT * FROM orders
            WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
        "merge_sync": _EXTRACT,
        "merge_clauses": """
            WITH s AS (SELECT l_orderkey AS k, count(*) AS n_lines, max(l_extendedprice) AS top_price
                       FROM lineitem GROUP BY l_orderkey)
            SELECT o_orderkey, o_custkey,
                   CASE WHEN k IS NULL THEN 'E'
                        WHEN n_lines <= 2 AND top_price < o_totalprice THEN 'S'
                        ELSE o_orderstatus END AS o_orderstatus,
                   CASE WHEN n_lines > 2 THEN top_price ELSE o_totalprice END AS o_totalprice,
                   o_orderdate, o_orderpriority
            FROM orders LEFT JOIN s ON o_orderkey = k
            WHERE CASE WHEN k IS NULL THEN o_orderstatus = 'O' ELSE NOT (n_lines >= 7 AND o_orderstatus = 'F') END""",
        "merge_repeated_target": """
            SELECT l_orderkey, l_partkey, CASE WHEN o_orderkey IS NULL THEN l_suppkey ELSE o_custkey END AS l_suppkey,
                   l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
                   CASE WHEN o_orderkey IS NULL THEN l_linestatus ELSE 'D' END AS l_linestatus, l_shipdate
            FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey""",
        "merge_nan_key": """
            SELECT o_orderkey, o_custkey, CASE WHEN hit THEN 'N' ELSE o_orderstatus END AS o_orderstatus,
                   CASE WHEN hit AND o_orderstatus <> 'F' THEN o_totalprice * 1.10 ELSE o_totalprice END AS o_totalprice,
                   o_orderdate, o_orderpriority,
                   CASE WHEN o_orderkey = 1 THEN -1.0 ELSE CAST(o_orderkey AS DOUBLE) END AS k
            FROM (SELECT *, o_orderstatus <> 'F' OR o_orderkey = 1 AS hit FROM orders)""",
        "alter_add": "SELECT *, CAST(NULL AS DOUBLE) AS bonus FROM orders",
        "alter_add_update": """
            SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority,
                   CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_custkey AS DOUBLE) + 0.5 END AS o_totalprice
            FROM orders""",
        "alter_drop": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders",
        "alter_rename": f"""
            SELECT o_orderkey, o_custkey, o_orderstatus, {_RAISED} AS price, o_orderdate, o_orderpriority AS priority
            FROM orders""",
        "alter_widen": "SELECT *, CAST(o_orderkey AS BIGINT) AS k FROM orders",
        "validate_count": "SELECT count(*) AS total FROM orders",
        "validate_unique": """
            SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem
            GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
        "namespace_create": """
            SELECT 'spark_catalog' AS catalog, 'datalake' AS namespace, 'customer' AS name, count(*) AS total
            FROM customer
            UNION ALL SELECT 'spark_catalog', 'datalake', 'orders', count(*) FROM orders""",
        "adhoc_sql": """
            SELECT c_mktsegment, o_orderstatus, count(*) AS n, max(o_totalprice) AS top
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderstatus""",
        "adhoc_sql_version": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
        "adhoc_sql_metadata": """
            SELECT version, operation, count(*) FILTER (WHERE o_orderstatus <> 'F') AS record_count, TRUE AS positive
            FROM orders, (VALUES (1, 'create'), (2, 'update'), (3, 'delete')) t(version, operation)
            GROUP BY version, operation""",
        "sql_update": f"SELECT * REPLACE ({_RAISED} AS o_totalprice) FROM orders",
        "sql_delete": """
            SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
        "sql_merge": """
            WITH l AS (SELECT l_orderkey AS k, count(*) AS n, max(l_extendedprice) AS top FROM lineitem GROUP BY l_orderkey)
            SELECT coalesce(o_orderkey, k) AS o_orderkey, o_custkey,
                   CASE WHEN top < o_totalprice THEN 'M' ELSE o_orderstatus END AS o_orderstatus,
                   CASE WHEN o_orderkey IS NULL OR top < o_totalprice THEN top ELSE o_totalprice END AS o_totalprice,
                   o_orderdate, CASE WHEN o_orderkey IS NULL THEN '9-NEW' ELSE o_orderpriority END AS o_orderpriority
            FROM orders RIGHT JOIN l ON o_orderkey = k WHERE o_orderkey IS NULL OR n < 6""",
        "sql_version_as_of": f"""
            SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN {_RAISED} - o_totalprice > 0 END AS raised,
                   o_orderstatus = 'F' AS gone
            FROM orders""",
        "merge_range": """
            WITH s AS (SELECT o_orderpriority AS p, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n
                       FROM orders GROUP BY o_orderpriority, floor(o_totalprice / 10000)
                       HAVING CAST(floor(any_value(o_totalprice) / 10000) AS BIGINT) % 3 <> 0)
            SELECT o_orderkey, coalesce(n, o_custkey) AS o_custkey,
                   CASE WHEN n IS NULL AND o_orderstatus = 'P' THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
                   coalesce(high, o_totalprice) AS o_totalprice, o_orderdate, o_orderpriority
            FROM orders LEFT JOIN s ON p = o_orderpriority AND o_totalprice BETWEEN low AND high
            WHERE n IS DISTINCT FROM 1""",
        "merge_window": """
            SELECT o_orderkey, CASE WHEN month(o_orderdate) <> 2 THEN year(o_orderdate) * 100 + month(o_orderdate)
                                    ELSE o_custkey END AS o_custkey,
                   o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
            FROM orders
            UNION ALL
            SELECT -1, NULL, 'N', NULL, NULL, NULL
            WHERE (SELECT month(date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH) FROM orders) <> 2""",
        "range_read": """
            SELECT * FROM orders
            WHERE o_orderkey BETWEEN 101 AND 400 AND o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderkey = 7""",
        "range_update": """
            SELECT * REPLACE (CASE WHEN o_orderkey < 500 AND o_orderstatus <> 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice)
            FROM orders WHERE o_orderkey < 900""",
        "file_bounds": """
            SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, CAST(0 AS BIGINT) AS nulls, count(*) AS record_count
            FROM orders""",
        "curve_read": """
            SELECT o_orderkey, 'customer' AS "by" FROM orders WHERE o_custkey BETWEEN 10 AND 30
            UNION ALL SELECT o_orderkey, 'price' FROM orders WHERE o_totalprice > 400000""",
        "feed_changes": f"""
            WITH was AS (SELECT * FROM orders),
            mid AS (SELECT * REPLACE ({_RAISED} AS o_totalprice) FROM orders WHERE o_orderstatus <> 'F'),
            now AS (SELECT * FROM mid WHERE o_orderkey % 10 <> 0
                    UNION ALL SELECT * REPLACE ('N' AS o_orderstatus) FROM orders WHERE o_orderkey % 10 = 0)
            SELECT *, 'insert' AS change, CAST(1 AS BIGINT) AS copies FROM (SELECT * FROM now EXCEPT ALL SELECT * FROM was)
            UNION ALL
            SELECT *, 'delete', CAST(1 AS BIGINT) FROM (SELECT * FROM was EXCEPT ALL SELECT * FROM now)""",
        "compact_files": """
            WITH two AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'P')
            SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 1.10 ELSE o_totalprice END AS o_totalprice),
                   'now' AS version FROM two
            UNION ALL SELECT *, 'before' FROM two""",
        "delete_scattered": """
            SELECT *, 'now' AS version FROM orders WHERE o_orderkey % 100 <> 7 AND o_custkey % 100 <> 9
            UNION ALL SELECT *, 'first' FROM orders""",
        "update_scattered": """
            SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 3 THEN o_totalprice * 1.10 ELSE o_totalprice END AS o_totalprice)
            FROM orders WHERE o_orderkey % 150 <> 53""",
        "raw_incremental": "SELECT * FROM orders",
        "batch_resume": f"""
            SELECT * REPLACE ({_RAISED} AS o_totalprice), 3 AS version FROM orders WHERE (o_orderstatus = 'F') IS NOT TRUE""",
        "drift_within_error": """
            WITH n AS (SELECT count(*) AS rows_old, count(*) + count(*) FILTER (WHERE o_orderstatus = 'P') AS rows_new FROM orders)
            SELECT 'o_totalprice' AS "column", rows_old, rows_new, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS share,
                   TRUE AS within FROM n
            UNION ALL SELECT 'o_custkey', rows_old, rows_new, NULL, TRUE FROM n
            UNION ALL SELECT 'o_orderkey', rows_old, rows_new, NULL, TRUE FROM n""",
    }
    if llm_queries is not None:
        out |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
