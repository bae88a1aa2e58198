"""History, snapshot summaries and data files of a table, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import listed, live_records
from ..sources.log import UnknownTable, log_rows, version_at
from ..sources.table import WRITE_ID, Table, stored_name


def _log(table: Table) -> DataFrame:
    rows = log_rows(table)
    if rows is None:
        raise UnknownTable(f"no table at {table.path}")
    return rows


def history(table: Table) -> DataFrame:
    """One row per version: when, from which, by what, and whether it leads to the current one."""
    rows = _log(table)
    start = rows.where("parent IS NULL").agg(F.max("version")).first()[0]
    return rows.select(
        F.col("committed_at").alias("made_current_at"),
        "version",
        "parent",
        "operation",
        (F.col("version") >= F.lit(start)).alias("is_current_ancestor"),
    )


def snapshots(table: Table) -> DataFrame:
    """One row per version: operation and counts of files, rows and bytes."""
    counts = (
        "total_records",
        "total_files",
        "total_bytes",
        "added_records",
        "added_files",
        "removed_records",
        "removed_files",
    )
    return _log(table).select(
        "committed_at", "version", "parent", "operation", *[F.col("summary")[c].alias(c) for c in counts]
    )


def files(table: Table, version: int | None = None) -> DataFrame:
    """One row per data file of a version. Reads the list of files, not the data.

    ``bounds`` has the lowest and the highest value, as text, and the NULLs of the columns
    whose ranges the table keeps.
    """
    at = version_at(table, version)
    names = F.create_map(*[x for f in at.schema if stored_name(f) in at.ranged for x in (F.lit(stored_name(f)), F.lit(f.name))])
    bounds = F.col("ranges")
    if at.ranged:
        bounds = F.transform_keys(F.map_filter(bounds, lambda k, _: names[k].isNotNull()), lambda k, _: names[k])
    below = F.regexp_replace("dir", f"^{WRITE_ID}=[^/]*/?", "")
    return listed(table, at).where("NOT dead").select(
        F.concat(F.lit(table.data + "/"), "name").alias("file_path"),
        below.alias("partition"),
        live_records().alias("record_count"),
        "file_size_in_bytes",
        bounds.alias("bounds"),
    )


def register_metadata_views(table: Table) -> list[str]:
    """Temporary views ``<name>_history``, ``<name>_snapshots`` and ``<name>_files`` for ``spark.sql``."""
    views = {"history": history(table), "snapshots": snapshots(table), "files": files(table)}
    for what, df in views.items():
        df.createOrReplaceTempView(f"{table.name}_{what}")
    return [f"{table.name}_{what}" for what in views]
