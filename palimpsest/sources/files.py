"""Which data files make up a version.

Every version names a list with one row per data file. The list is a DataFrame;
only the paths that Spark's reader needs ever come to the driver, and a folder
whose files are all wanted comes as the one folder path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import Bounds
from .log import Version, commit
from .table import WRITE_ID, Table, col, stored_name, stored_schema

FILES_SCHEMA = (
    "name string, dir string, whole_dir boolean, record_count bigint, file_size_in_bytes bigint, dead boolean,"
    " ranges map<string,struct<low:string,high:string,nulls:bigint>>, holes bigint, holes_in string"
)
COLUMNS = ["name", "dir", "whole_dir", "record_count", "file_size_in_bytes", "dead", "ranges", "holes", "holes_in"]
# ``record_count`` and ``ranges`` are of all rows stored; ``holes`` of them are deleted by position: a list of the write ``holes_in`` names them.

RANGED_TYPES = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Characters of a text that its bounds keep.
BOUND_CHARS = 64


def file_name(file_path: Column) -> Column:
    """Path below ``data/`` as it is on storage, from the encoded ``_metadata.file_path``.

    ``url_decode`` turns a plus sign into a space, so plus signs are encoded first.
    """
    below = F.substring_index(file_path, f"/data/{WRITE_ID}=", -1)
    return F.concat(F.lit(f"{WRITE_ID}="), F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))))


def listed(table: Table, version: Version) -> DataFrame:
    """The list of a version: its files, and those of its folders that are ``dead``, part of older versions only."""
    rows = table.spark.read.schema(FILES_SCHEMA).parquet(table.files_dir(version.files))
    return rows.withColumns({"dead": F.coalesce("dead", F.lit(False)), "holes": F.coalesce("holes", F.lit(0).cast("bigint"))})


def live_records() -> Column:
    """Of a list: the rows of a file that are there, without those deleted by position."""
    return F.col("record_count") - F.col("holes")


def _as_bound(value: Column, data_type: T.DataType, high: bool) -> Column:
    """A bound as text. A long text's lower bound is its beginning; it has no upper one."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(value).cast("string")  # a text would depend on the time zone
    if isinstance(data_type, T.StringType):
        return F.when(F.length(value) <= BOUND_CHARS, value) if high else F.substring(value, 1, BOUND_CHARS)
    return value.cast("string")


def bounds_of(f: T.StructField) -> Bounds | None:
    """The bounds of a column in a list of files, in its type."""
    if not isinstance(f.dataType, RANGED_TYPES):
        return None
    entry = F.col("ranges")[F.lit(stored_name(f))]

    def typed(bound: Column) -> Column:
        if isinstance(f.dataType, T.TimestampType):
            return F.timestamp_micros(bound.cast("bigint"))
        return bound.cast(f.dataType)

    return Bounds(typed(entry["low"]), typed(entry["high"]), entry["nulls"], F.col("record_count"))


def written(table: Table, write_id: str, format: str, schema, ranged: tuple[str, ...] = ()) -> DataFrame:
    """List rows for the files of one write. Reads the columns whose bounds are kept, and row counts."""
    stored = stored_schema(schema)
    kept = [f for f in stored if f.name in ranged and isinstance(f.dataType, RANGED_TYPES)]
    facts, entries = [], []
    for i, f in enumerate(kept):
        value = col(f.name)
        facts += [F.min(value).alias(f"low_{i}"), F.max(value).alias(f"high_{i}"), F.count(value).alias(f"there_{i}")]
        entries += [
            F.lit(f.name),
            F.struct(
                _as_bound(F.col(f"low_{i}"), f.dataType, False).alias("low"),
                _as_bound(F.col(f"high_{i}"), f.dataType, True).alias("high"),
                (F.col("record_count") - F.col(f"there_{i}")).alias("nulls"),
            ),
        ]
    kind = "map<string,struct<low:string,high:string,nulls:bigint>>"
    ranges = F.create_map(*entries).cast(kind) if entries else F.lit(None).cast(kind)
    return (
        table.spark.read.format(format)
        .schema(stored)
        .option("basePath", table.data)
        .load(table.data_dir(write_id))
        .groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        .agg(F.count(F.lit(1)).alias("record_count"), *facts)
        .select(
            file_name(F.col("path")).alias("name"),
            "record_count",
            F.col("size").alias("file_size_in_bytes"),
            ranges.alias("ranges"),
        )
        .select(
            "name",
            F.regexp_replace("name", "/[^/]*$", "").alias("dir"),
            F.lit(True).alias("whole_dir"),
            "record_count",
            "file_size_in_bytes",
            F.lit(False).alias("dead"),
            "ranges",
            F.lit(0).cast("bigint").alias("holes"),
            F.lit(None).cast("string").alias("holes_in"),
        )
    )


class Reads(list):
    """Paths to hand to the reader, the names of dead files below them, and the writes whose lists name deleted rows of theirs."""

    excluded: tuple[str, ...] = ()
    holes: tuple[str, ...] = ()


class UnlistedFile(RuntimeError):
    """A statement found rows in a file that the list of its version does not have."""


def paths(table: Table, files: DataFrame, wanted: Column | None = None) -> Reads:
    """What to read for the wanted files of a list.

    A folder all of whose live files are wanted is read as a folder, and its few dead
    files are left out by name (Spark then does not open them), so that what comes to the
    driver grows with the folders and the files changed. Where more are dead than alive,
    or only some are wanted, files are named one by one.
    """
    wanted = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    mine = ~F.col("dead") & wanted
    n = {
        "n_mine": mine,
        "n_rest": ~F.col("dead") & ~wanted,
        "n_dead": F.col("dead"),
    }
    folder = F.col("whole") & (F.col("n_rest") == 0) & (F.col("n_dead") <= F.col("n_mine"))
    dirs = (
        files.groupBy("dir")
        .agg(
            F.bool_and("whole_dir").alias("whole"),
            *[F.count_if(c).alias(k) for k, c in n.items()],
            F.collect_list(F.when(mine, F.col("name"))).alias("mine"),
            F.collect_list(F.when(F.col("dead"), F.col("name"))).alias("gone"),
            F.collect_set(F.when(mine & (F.col("holes") > 0), F.col("holes_in"))).alias("holes"),
        )
        .where("n_mine > 0 OR dir IS NULL")
        .select("dir", folder.alias("folder"), F.when(folder, F.col("gone")).otherwise(F.col("mine")).alias("names"), "holes")
    )
    found = dirs.collect()
    if any(r["dir"] is None for r in found):
        raise UnlistedFile(f"{table.path}: rows were found in files that are not in the list of the version")
    result = Reads()
    for r in sorted(found, key=lambda r: r["dir"]):
        result += [f"{table.data}/{p}" for p in ([r["dir"]] if r["folder"] else sorted(r["names"]))]
    result.excluded = tuple(n for r in found if r["folder"] for n in r["names"])
    result.holes = tuple(sorted({w for r in found for w in r["holes"]}))
    return result


def touching(files: DataFrame, touched: DataFrame) -> DataFrame:
    """The list with ``matched`` for the touched files; a touched file not in it has no ``dir``."""
    return files.join(touched, "name", "full")


def without(files: DataFrame, touched: DataFrame) -> DataFrame:
    """The list with the touched files dead; folders with no live file left are not in it."""
    names = touched.select("name", F.lit(True).alias("cut"))
    marked = files.join(names, "name", "left").withColumn("dead", F.col("dead") | F.coalesce("cut", F.lit(False)))
    alive = marked.where("NOT dead").select("dir").distinct()
    return marked.join(alive, "dir", "left_semi").select(COLUMNS)


def commit_files(
    table: Table,
    *,
    write_id: str,
    number: int,
    before: Version | None,
    kept: DataFrame | None,
    wrote: bool,
    operation: str,
    format: str,
    schema,
    partitioned_by: tuple[str, ...],
    compression: str,
    ranged: tuple[str, ...] = (),
    replaced: Version | None = None,
) -> int:
    """Make a version out of the kept files of the one before and the files just written.

    ``before`` is None when the table starts afresh; then no file is kept, and all rows of
    the version ``replaced``, if there is one, count as removed.
    """
    new = written(table, write_id, format, schema, ranged) if wrote else None
    rows = kept if new is None else new if kept is None else kept.select(COLUMNS).unionByName(new)
    mine = F.col("dir").startswith(f"{WRITE_ID}={write_id}")
    records, one = live_records(), F.lit(1)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    rows.write.mode("errorifexists").parquet(table.files_dir(write_id))
    list_rows = table.spark.read.schema(FILES_SCHEMA).parquet(table.files_dir(write_id))
    counts = list_rows.where("NOT dead").agg(
        total(records).alias("total_records"),
        total(one).alias("total_files"),
        total(F.col("file_size_in_bytes")).alias("total_bytes"),
        total(F.when(mine, records)).alias("added_records"),
        total(F.when(mine, one)).alias("added_files"),
    )
    summary = counts.first().asDict()
    for what in ("records", "files"):
        counted = before or replaced
        old = counted.summary[f"total_{what}"] if counted else 0
        summary[f"removed_{what}"] = old - summary[f"total_{what}"] + summary[f"added_{what}"]
    return commit(
        table,
        summary,
        number=number,
        parent=before.number if before else None,
        operation=operation,
        files=write_id,
        format=format,
        schema=schema,
        partitioned_by=partitioned_by,
        compression=compression,
        ranged=ranged,
    )


def commit_same_files(table: Table, before: Version, operation: str, schema=None) -> int:
    """A version with the same data files: a new schema, or a statement that hit no row."""
    totals = {k: v for k, v in before.summary.items() if k.startswith("total_")}
    changes = dict.fromkeys(("added_records", "added_files", "removed_records", "removed_files"), 0)
    return commit(
        table,
        {**totals, **changes},
        number=before.number + 1,
        parent=before.number,
        operation=operation,
        files=before.files,
        format=before.format,
        schema=schema or before.schema,
        partitioned_by=before.partitioned_by,
        compression=before.compression,
        ranged=before.ranged,
    )
