"""UPDATE and DELETE: rewrite the data files that hold a row to change, leave the others.

With ``by_position`` files of which few rows change stay too: those rows are deleted by position.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import require_repeatable
from ..functions.rows import as_condition, deleted, updated
from ..sources.data import clustered, load, may_hold
from ..sources.files import commit_same_files, file_name, listed, live_records, paths
from ..sources.log import version_at
from ..sources.table import Table, find, new_write_id, empty_folder
from .positions import FEW, kept_files, split, write_holes
from .write import write_next

PATH = "palimpsest_path"


def by_mark(rows: DataFrame) -> DataFrame:
    """Rows with a hash of their file in the place of its path, which is many times as wide as what is sorted with it."""
    return rows.withColumn(PATH, F.xxhash64(file_name(F.col(PATH))))


def stage_touched(table: Table, hits: DataFrame, write_id: str, marked: DataFrame | None = None) -> DataFrame:
    """Files holding the given rows, with how many each holds, as a written table.

    ``hits`` only needs its PATH column: Spark then reads the condition's columns
    and nothing else, and counts before it shuffles. Of hits by mark the list of files,
    ``marked``, has the names; of two files with one mark both are touched.
    """
    at = table.staging_dir(write_id, "touched")
    counted = hits.groupBy(PATH).agg(F.count(F.lit(1)).alias("matched"))
    if marked is None:
        counted = counted.select(file_name(F.col(PATH)).alias("name"), "matched")
    else:
        names = marked.where("NOT dead").select("name", F.xxhash64("name").alias("mark"))
        # A mark that no file has keeps its row, and is refused like a file that is not in the list.
        name = F.coalesce("name", F.col(PATH).cast("string")).alias("name")
        counted = counted.join(names, F.col(PATH) == F.col("mark"), "left").select(name, "matched")
    counted.write.parquet(at)
    return table.spark.read.schema("name string, matched bigint").parquet(at)


def empty_staging(table: Table, write_id: str) -> None:
    """Remove a statement's intermediate tables, once its version is there. Runs no job."""
    empty_folder(table.spark, table.staging_dir(write_id))


def update(
    table: Table,
    condition: Column | str,
    assignments: Mapping[str, Any],
    *,
    alias: str | None = None,
    by_position: float = 0.0,
) -> int:
    """Give new values to the rows where the condition is TRUE; return the new version.

    Values are Columns, SQL text, or plain numbers and dates (text values need
    ``F.lit``). Rows whose partition column is assigned move to another partition.
    ``alias`` is what the condition and the values may call the table.

    ``by_position`` is the largest share of a file's rows that may be deleted by position:
    below it, the old rows are listed as deleted and only the new ones are written. On ORC,
    and where a version would have more than MOST_HOLES such rows, files are written anew.
    """
    before = version_at(table)
    condition = as_condition(condition)
    known = listed(table, before)
    current = _named(load(table, before, paths(table, known, may_hold(table, before, condition, alias)), PATH), alias)
    require_repeatable(current, condition)
    updated(current, condition, assignments)  # fails here on a wrong name or type, before any job

    write_id = new_write_id(before.number + 1)
    touched = stage_touched(table, current.where(condition), write_id)
    hit = split(table, before, known, touched, by_position)
    again = paths(table, hit.marked, F.col("matched").isNotNull() & ~F.col(FEW))
    if not again and not hit.few:
        return commit_same_files(table, before, "update")
    parts = [_named(load(table, before, again), alias)] if again else []
    if hit.few:
        write_holes(table, before, hit, condition, alias, write_id)
        parts.append(_named(load(table, before, hit.few), alias).where(condition))
    rows = reduce(DataFrame.unionByName, [updated(p, condition, assignments) for p in parts])
    if any(find(before.schema, c).name in before.partition_columns for c in assignments):
        rows = clustered(rows, before.partition_columns)
    version = write_next(table, before, write_id, "update", rows, kept_files(known, touched, hit, write_id))
    empty_staging(table, write_id)
    return version


def delete(table: Table, condition: Column | str, *, alias: str | None = None, by_position: float = 0.0) -> int:
    """Drop the rows where the condition is TRUE; return the new version.

    A file all of whose rows go is left out of the new version without reading it
    again, so deleting whole partitions rewrites nothing. ``by_position`` as in ``update``:
    of files below that share no row is written.
    """
    before = version_at(table)
    condition = as_condition(condition)
    known = listed(table, before)
    current = _named(load(table, before, paths(table, known, may_hold(table, before, condition, alias)), PATH), alias)
    require_repeatable(current, condition)

    write_id = new_write_id(before.number + 1)
    touched = stage_touched(table, current.where(condition), write_id)
    hit = split(table, before, known, touched, by_position)
    again = paths(table, hit.marked, (F.col("matched") < live_records()) & ~F.col(FEW))
    if not again and touched.isEmpty():
        return commit_same_files(table, before, "delete")
    if hit.few:
        write_holes(table, before, hit, condition, alias, write_id)
    rows = deleted(_named(load(table, before, again), alias), condition) if again else None
    version = write_next(table, before, write_id, "delete", rows, kept_files(known, touched, hit, write_id))
    empty_staging(table, write_id)
    return version


def _named(rows: DataFrame, alias: str | None) -> DataFrame:
    return rows.alias(alias) if alias else rows
