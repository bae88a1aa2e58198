"""Compaction: the same rows in fewer files."""

from __future__ import annotations


from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.data import load
from ..sources.files import file_name, listed, paths, touching, without
from ..sources.log import version_at
from ..sources.table import WRITE_ID, Table, new_write_id
from .change import PATH, empty_staging
from .write import write_next

TARGET_BYTES = 128 << 20
#: Files below this share of the target are packed.
SMALL = 0.75
#: Files that are packed by one call; a partition with more of them is dealt out by a hash.
TOGETHER = 4096

#: Rows of a bin: however few bytes they take on storage, its task sorts them.
TOGETHER_ROWS = 1 << 22

BIN = "palimpsest_bin"
#: The place of a file in its bin; a path would be many times as wide as most rows.
NTH = "palimpsest_nth"


def packer(room: int, most_rows: int | None = None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Puts files in bins: from the largest on, each in the first bin with room for it, and for its rows if they are bounded.

    All it needs is inside, so that it can be sent to executors without this package.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["file_size_in_bytes", "name"], ascending=[False, True])
        counts = group["record_count"].tolist() if most_rows else [0] * len(group)
        left: list[list[int]] = []
        bins = []
        for size, n in zip(group["file_size_in_bytes"].tolist(), counts, strict=True):
            b = next((b for b, free in enumerate(left) if size <= free[0] and n <= free[1]), len(left))
            if b == len(left):
                left.append([room, most_rows or 0])
            left[b][0] -= size
            left[b][1] -= n
            bins.append(b)
        return group[["name", "partition", "part", "hollow"]].assign(bin=bins)

    return pack


def packed(files: DataFrame, target_bytes: int = TARGET_BYTES, small: float = SMALL) -> DataFrame:
    """(name, nth, bin): the files of a list to write together, by numbers from 0, and their places there.

    Those are small files, files with rows deleted by position, and files of folders most
    of whose files are dead, which opening the table would name one by one. A bin is of one partition value; one small
    file alone in its bin stays as it is.
    """
    partition = F.regexp_replace("dir", f"^{WRITE_ID}=[^/]*/?", "")
    folders = files.groupBy("dir").agg((F.count_if(F.col("dead")) > F.count_if(~F.col("dead"))).alias("hollow"))
    live = files.where("NOT dead").join(folders, "dir").withColumn("partition", partition)
    live = live.withColumn("hollow", F.col("hollow") | (F.col("holes") > 0))
    chosen = live.where(F.col("hollow") | (F.col("file_size_in_bytes") < small * target_bytes))
    many = chosen.groupBy("partition").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("groups"))
    chosen = chosen.join(many, "partition").withColumn("part", F.pmod(F.xxhash64("name"), F.col("groups")))

    kind = "name string, partition string, part bigint, hollow boolean, bin int"
    columns = chosen.select("name", "partition", "part", "hollow", "file_size_in_bytes", "record_count")
    bins = columns.groupBy("partition", "part").applyInPandas(packer(target_bytes, TOGETHER_ROWS), kind)
    key = ["partition", "part", "bin"]
    # One row for each bin that has anything to do; numbering them takes one task.
    worth = bins.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_or("hollow").alias("any")).where("n > 1 OR any")
    numbered = worth.withColumn(BIN, (F.row_number().over(Window.orderBy(*key)) - 1).cast("int"))
    place = (F.row_number().over(Window.partitionBy(*key).orderBy("name")) - 1).cast("int").alias(NTH)
    return bins.join(numbered.select(*key, BIN), key).select("name", place, BIN)


def compact(table: Table, *, target_bytes: int = TARGET_BYTES, small: float = SMALL) -> int:
    """Write small files, files with rows deleted by position and those of hollowed-out folders anew, together; return the version.

    No row, schema or older version changes, and rows keep their order within a file. A
    bin is one task and one file of about ``target_bytes``, less where TOGETHER_ROWS rows take fewer. Where there is nothing to do no
    version is made.
    """
    before = version_at(table)
    files = listed(table, before)
    write_id = new_write_id(before.number + 1)
    at = table.staging_dir(write_id, "bins")
    packed(files, target_bytes, small).write.parquet(at)
    bins = table.spark.read.schema(f"name string, {NTH} int, {BIN} int").parquet(at)
    n = (bins.agg(F.max(BIN)).first()[0] or 0) + 1 if not bins.isEmpty() else 0
    if n == 0:
        empty_staging(table, write_id)
        return before.number
    touched = bins.select("name", F.lit(1).cast("bigint").alias("matched"))
    again = paths(table, touching(files, touched), F.col("matched").isNotNull())
    numbered = before.format == "parquet"
    rows = load(table, before, again, PATH, "palimpsest_row" if numbered else None)
    rows = rows.withColumn("palimpsest_name", file_name(F.col(PATH)))
    rows = rows.join(bins.withColumnRenamed("name", "palimpsest_file"), F.col("palimpsest_name") == F.col("palimpsest_file"))
    rows = rows.repartitionById(n, F.col(BIN)) if hasattr(rows, "repartitionById") else rows.repartitionByRange(n, BIN)
    # Rows of a bin come file by file; the order within a file is kept where rows have numbers.
    rows = rows.sortWithinPartitions(*before.partition_columns, BIN, NTH, *(["palimpsest_row"] if numbered else []))
    version = write_next(table, before, write_id, "compact", rows.select(before.columns.names), without(files, touched))
    empty_staging(table, write_id)
    return version
