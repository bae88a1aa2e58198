"""The log: one row per version, written last, so a version is there whole or not at all."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .table import Table, plain_schema, stored_name

LOG_SCHEMA = (
    "version int, parent int, committed_at timestamp, operation string, files string, format string,"
    " schema string, partitioned_by array<string>, summary map<string,bigint>, compression string, ranged array<string>"
)

COMPRESSION = "zstd"

_VERSION = re.compile(r"/version=(\d+)/[^/]+$")


class UnknownTable(LookupError):
    pass


class UnknownVersion(LookupError):
    pass


class ConcurrentWrite(RuntimeError):
    """Another writer made the version this one was about to make."""


@dataclass(frozen=True)
class Version:
    number: int
    parent: int | None
    operation: str
    files: str
    format: str
    schema: T.StructType
    partitioned_by: tuple[str, ...]
    summary: dict[str, int]
    compression: str = COMPRESSION
    ranged: tuple[str, ...] = ()  # stored names of the columns whose bounds are kept for each file

    @property
    def columns(self) -> T.StructType:
        return plain_schema(self.schema)

    @property
    def partition_columns(self) -> list[str]:
        return [f.name for p in self.partitioned_by for f in self.schema if stored_name(f) == p]


def log_rows(table: Table) -> DataFrame | None:
    """The log as a DataFrame, None where there is no table yet."""
    try:
        return table.spark.read.schema(LOG_SCHEMA).parquet(table.log)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def last_version(table: Table) -> int:
    """Newest version number, 0 where there is no table yet. Lists the log, runs no job."""
    rows = log_rows(table)
    return 0 if rows is None else max((int(n) for p in rows.inputFiles() for n in _VERSION.findall(p)), default=0)


def version_at(table: Table, number: int | None = None) -> Version:
    """The given version, or the newest. Opens the one log file of that version."""
    if number is None:
        number = last_version(table)
        if number == 0:
            raise UnknownTable(f"no table at {table.path}")
    try:
        one = table.spark.read.schema(LOG_SCHEMA).option("basePath", table.log).parquet(table.log_dir(number))
        found = one.take(2)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if not found:
        raise UnknownVersion(f"{table.path} has no version {number}")
    if len(found) > 1:
        raise ConcurrentWrite(f"two writers made version {number} of {table.path} at the same time")
    row = found[0]
    return Version(
        number=row["version"],
        parent=row["parent"],
        operation=row["operation"],
        files=row["files"],
        format=row["format"],
        schema=T.StructType.fromJson(json.loads(row["schema"])),
        partitioned_by=tuple(row["partitioned_by"]),
        summary=dict(row["summary"]),
        compression=row["compression"] or COMPRESSION,
        ranged=tuple(row["ranged"] or ()),
    )


def version_before(table: Table, moment: Column) -> int:
    """The version that was current at a moment: the last one committed until then."""
    rows = log_rows(table)
    found = None if rows is None else rows.where(F.col("committed_at") <= moment.cast("timestamp")).agg(F.max("version")).first()[0]
    if found is None:
        raise UnknownVersion(f"{table.path} had no version at that time")
    return found


def commit(
    table: Table,
    summary: dict[str, int],
    *,
    number: int,
    parent: int | None,
    operation: str,
    files: str,
    format: str,
    schema: T.StructType,
    partitioned_by: tuple[str, ...],
    compression: str = COMPRESSION,
    ranged: tuple[str, ...] = (),
) -> int:
    """Write the log row of a version, as one file."""
    entries: list[Column] = []
    for name, n in summary.items():
        entries += [F.lit(name), F.lit(n).cast("bigint")]
    row = table.spark.range(0, 1, 1, numPartitions=1).select(
        F.lit(parent).cast("int").alias("parent"),
        F.current_timestamp().alias("committed_at"),
        F.lit(operation).alias("operation"),
        F.lit(files).alias("files"),
        F.lit(format).alias("format"),
        F.lit(schema.json()).alias("schema"),
        F.array([F.lit(p) for p in partitioned_by]).cast("array<string>").alias("partitioned_by"),
        F.create_map(entries).alias("summary"),
        F.lit(compression).alias("compression"),
        F.array([F.lit(c) for c in ranged]).cast("array<string>").alias("ranged"),
    )
    if last_version(table) >= number:
        raise ConcurrentWrite(f"{table.path} already has version {number}")
    try:
        row.write.mode("errorifexists").parquet(table.log_dir(number))
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        if last_version(table) >= number:
            raise ConcurrentWrite(f"{table.path} already has version {number}") from e
        # A writer died while writing this very row: the folder holds no version.
        row.write.mode("overwrite").parquet(table.log_dir(number))
    return number
