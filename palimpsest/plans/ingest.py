"""Raw data that lands file by file: every file is taken once.

Which files a version took is written beside it, ``<table>/taken/<write id>/``, before the
version is there, and counts only if it is: a run that dies leaves neither its rows nor its
files behind for a reader, and running it again takes them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.write import append, create_or_replace
from ..sources.log import last_version, log_rows
from ..sources.raw import read_raw
from ..sources.table import Table

TAKEN_SCHEMA = "path string, size bigint, modified timestamp"


class ChangedFile(RuntimeError):
    """A file that was taken is there again with another size or time."""


def landed(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """Path, size and time of the files below a path. Opens none of them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def taken_files(table: Table) -> DataFrame:
    """Path, size and time of every file that a version of the table took, and the first version that did."""
    spark = table.spark
    nothing = spark.createDataFrame([], f"{TAKEN_SCHEMA}, version int")
    versions = log_rows(table)
    if versions is None:
        return nothing
    try:
        rows = spark.read.schema(TAKEN_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{table.path}/taken")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return nothing
    write_id = F.regexp_extract(F.col("_metadata.file_path"), "/taken/([^/]+)/", 1)
    made = versions.groupBy(F.col("files").alias("write_id")).agg(F.min("version").alias("version"))
    return rows.withColumn("write_id", write_id).join(made, "write_id").drop("write_id")


def ingest(
    table: Table,
    path: str | list[str],
    schema: T.StructType | str,
    format: str = "parquet",
    *,
    pattern: str | None = None,
    partition_by: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
    changed: str = "fail",
) -> int | None:
    """Append the rows of files that no version has taken yet; return the version, or None where there are none.

    The first run makes the table. A file that was taken and is there with another size or
    time fails the run, or is taken again with ``changed="take"``. The new files' names come
    to the driver, as Spark's reader needs them.
    """
    if changed not in ("fail", "take"):
        raise ValueError(f"changed is 'fail' or 'take', not {changed!r}")
    there = landed(table.spark, path, pattern)
    known = taken_files(table).select("path", "size", "modified").distinct()
    fresh = there.join(known, ["path", "size", "modified"], "left_anti")
    if changed == "fail":
        other = fresh.join(known.select("path"), "path", "left_semi").first()
        if other is not None:
            raise ChangedFile(f"{other['path']} was taken with another size or time")
    files = fresh.collect()
    if not files:
        return None
    rows = read_raw(table.spark, [f["path"] for f in files], schema, format, **(options or {}))
    ledger = table.spark.createDataFrame(files, TAKEN_SCHEMA)

    def note(write_id: str) -> None:
        ledger.coalesce(1).write.mode("errorifexists").parquet(f"{table.path}/taken/{write_id}")

    if last_version(table):
        return append(rows, table, before_commit=note)
    return create_or_replace(rows, table, partition_by=partition_by, before_commit=note)
