"""Reading and writing the data files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import analysed, may_be_true
from .files import bounds_of, file_name, listed, paths
from .log import Version, version_at
from .table import Table, col, stored_name, stored_schema, to_stored

FORMATS = ("parquet", "orc")

# A row deleted by position: its file, as lists of files name it, and its number there.
HOLE_FILE, HOLE_ROW = "palimpsest_hole_file", "palimpsest_hole_row"
HOLES_SCHEMA = f"{HOLE_FILE} string, {HOLE_ROW} bigint"

# What Spark names the folder of rows whose partition value is NULL.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def load(
    table: Table, version: Version, from_paths: list[str], path_as: str | None = None, row_as: str | None = None
) -> DataFrame:
    """The rows under the given paths, with the columns of a version, without those deleted by position.

    ``path_as`` names an extra column for the data file each row is in, ``row_as`` one for
    its number in the file, which only Parquet files have.
    """
    if not from_paths:
        names = version.columns
        if path_as:
            names = T.StructType([*names, T.StructField(path_as, T.StringType())])
        if row_as:
            names = T.StructType([*names, T.StructField(row_as, T.LongType())])
        return table.spark.createDataFrame([], names)
    rows = (
        table.spark.read.format(version.format)
        .schema(stored_schema(version.schema))
        .option("basePath", table.data)
        .load(list(from_paths))
    )
    excluded = getattr(from_paths, "excluded", ())
    if excluded:
        rows = rows.where(~file_name(F.col("_metadata.file_path")).isin(*excluded))
    out = [col(stored_name(f)).alias(f.name) for f in version.schema]
    if path_as:
        out.append(F.col("_metadata.file_path").alias(path_as))
    if row_as:
        out.append(F.col("_metadata.row_index").alias(row_as))
    holes = getattr(from_paths, "holes", ())
    if not holes:
        return rows.select(out)
    place = [file_name(F.col("_metadata.file_path")).alias(HOLE_FILE), F.col("_metadata.row_index").alias(HOLE_ROW)]
    left = rows.select(*out, *place).join(hole_rows(table, holes), [HOLE_FILE, HOLE_ROW], "left_anti")
    return left.drop(HOLE_FILE, HOLE_ROW)


def hole_rows(table: Table, write_ids: Sequence[str]) -> DataFrame:
    """Rows deleted by position by the given writes. What is deleted in a file stays so, so later lists only have more."""
    return table.spark.read.schema(HOLES_SCHEMA).parquet(*[table.holes_dir(w) for w in write_ids])


def scan(table: Table, version: Version, path_as: str | None = None) -> DataFrame:
    return load(table, version, paths(table, listed(table, version)), path_as)


def may_hold(table: Table, version: Version, condition: Column, alias: str | None = None) -> Column | None:
    """Of a list of files, which can hold a row for which the condition is TRUE; None where no bounds are kept.

    Partition columns have no bounds: Spark prunes by them itself.
    """
    if not version.ranged:
        return None
    fields = {f.name: f for f in version.schema if stored_name(f) in version.ranged}
    empty = table.spark.createDataFrame([], version.columns)
    expression = analysed(empty.alias(alias) if alias else empty, condition)
    return may_be_true(expression, lambda name: bounds_of(fields[name]) if name in fields else None)


def read(table: Table, version: int | None = None, where: Column | str | None = None) -> DataFrame:
    """The table as it is now, or as it was at a version (versions count from 1).

    With a condition only its rows; files whose bounds rule it out are not opened.
    """
    at = version_at(table, version)
    if where is None:
        return scan(table, at)
    where = F.expr(where) if isinstance(where, str) else where
    return load(table, at, paths(table, listed(table, at), may_hold(table, at, where))).where(where)


#: Tasks among which the rows of one partition value are dealt when adaptive execution is off.
SALTS = 4


def clustered(df: DataFrame, columns: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Bring the rows of a partition together, so that not every task writes into every partition.

    Adaptive execution cuts a partition value that holds much of the rows into many
    tasks of even size. Without it, a hash of the row deals every value out to
    ``salts`` tasks.
    """
    if not columns:
        return df
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        return df.hint("rebalance", *[col(c) for c in columns])
    hashed = [col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()]
    return df.repartition(*[col(c) for c in columns], F.pmod(F.xxhash64(*hashed), F.lit(salts)))


def write(
    table: Table,
    df: DataFrame,
    *,
    write_id: str,
    format: str,
    schema: T.StructType,
    partitioned_by: tuple[str, ...],
    compression: str,
) -> None:
    """Write rows as the data files of one write, each task what it holds."""
    stored = to_stored(df, schema)
    for f in stored.schema:
        if f.name in partitioned_by and isinstance(f.dataType, T.StringType):
            bad = col(f.name).isin("", NULL_PARTITION)
            message = F.lit(f"column {f.name} partitions the table and cannot hold '' or '{NULL_PARTITION}'")
            stored = stored.withColumn(f.name, F.when(bad, F.raise_error(message)).otherwise(col(f.name)))
    writer = stored.write.mode("errorifexists").format(format).option("compression", compression)
    if partitioned_by:
        writer = writer.partitionBy(*partitioned_by)
    writer.save(table.data_dir(write_id))
