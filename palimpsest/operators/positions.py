"""Rows deleted by position: (file, row number) lists beside the data files, which stay as they are.

A scan leaves listed rows out by an anti join on file and row number, which Spark broadcasts
or shuffles by the size of the lists. Only Parquet files have row numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.data import HOLE_FILE, HOLE_ROW, hole_rows, load
from ..sources.files import COLUMNS, Reads, file_name, live_records, paths, touching, without
from ..sources.log import Version
from ..sources.table import Table

#: Rows that may be deleted by position in one version; beyond it files are written anew.
MOST_HOLES = 1 << 18
#: Lists a version may have; the next one takes all of theirs in.
MOST_LISTS = 16

FEW = "palimpsest_few"
_PATH, _ROW = "palimpsest_path", "palimpsest_row"


@dataclass(frozen=True)
class Split:
    """The files a statement hits: ``few`` lose rows by position, those in ``marked`` without FEW are written anew."""

    marked: DataFrame
    few: Reads
    lists: tuple[str, ...]


def split(table: Table, version: Version, known: DataFrame, touched: DataFrame, share: float) -> Split:
    """Which of the touched files keep all rows stored, as at most ``share`` of these are deleted then."""
    if not 0 <= share < 1:
        raise ValueError(f"by_position is a share of a file's rows below 1, not {share}")
    marked = touching(known, touched)
    few = ~F.col("dead") & (F.col("matched") < live_records())
    few = few & (F.col("matched") + F.col("holes") <= F.lit(share) * F.col("record_count"))
    marked = marked.withColumn(FEW, F.coalesce(few, F.lit(False)))
    none = Split(marked.withColumn(FEW, F.lit(False)), Reads(), ())
    if share == 0 or version.format != "parquet":
        return none
    facts = marked.agg(
        F.count_if(FEW).alias("files"),
        F.sum(F.when(F.col(FEW), F.col("matched"))).alias("more"),
        F.sum(F.when(~F.col("dead"), F.col("holes"))).alias("holes"),
        F.collect_set(F.when(~F.col("dead") & (F.col("holes") > 0), F.col("holes_in"))).alias("lists"),
    ).first()
    if not facts["files"] or facts["more"] + facts["holes"] > MOST_HOLES:
        return none
    return Split(marked, paths(table, marked, F.col(FEW)), tuple(sorted(facts["lists"])))


def write_holes(table: Table, version: Version, files: Split, condition: Column, alias: str | None, write_id: str) -> None:
    """Write the list of a statement: its rows in the files of ``few``, and what was deleted there before.

    It has at most MOST_HOLES rows, and is written by one task.
    """
    rows = load(table, version, files.few, _PATH, _ROW)
    hit = (rows.alias(alias) if alias else rows).where(condition)
    holes = hit.select(file_name(F.col(_PATH)).alias(HOLE_FILE), F.col(_ROW).alias(HOLE_ROW))
    if files.lists:
        again = files.marked.where(_listed_anew(files)).select(F.col("name").alias(HOLE_FILE))
        holes = holes.unionByName(hole_rows(table, files.lists).join(again, HOLE_FILE, "left_semi").distinct())
    holes.repartition(1).sortWithinPartitions(HOLE_FILE, HOLE_ROW).write.parquet(table.holes_dir(write_id))


def kept_files(known: DataFrame, touched: DataFrame, files: Split, write_id: str) -> DataFrame:
    """The list of files after the statement, without what it writes."""
    if not files.few:
        return without(known, touched)
    few = files.marked.where(FEW).select("name")
    anew = files.marked.where(_listed_anew(files)).select("name", F.when(F.col(FEW), F.col("matched")).alias("more"), F.lit(write_id).alias("anew"))
    kept = without(known, touched.join(few, "name", "left_anti")).join(anew, "name", "left")
    holes = F.col("holes") + F.coalesce("more", F.lit(0))
    return kept.withColumns({"holes": holes, "holes_in": F.coalesce("anew", "holes_in")}).select(COLUMNS)


def _listed_anew(files: Split) -> Column:
    """The files whose deleted rows the new list names: those that lose more, or all where there are many lists."""
    if len(files.lists) < MOST_LISTS:
        return F.col(FEW)
    untouched = F.col("matched").isNull() & ~F.col("dead") & (F.col("holes") > 0)
    return F.col(FEW) | F.coalesce(untouched, F.lit(False))
