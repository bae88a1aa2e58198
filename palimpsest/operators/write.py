"""Create, replace and append."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.curve import along_curve
from ..sources.data import FORMATS, clustered, write
from ..sources.files import commit_files, listed
from ..sources.log import COMPRESSION, Version, last_version, version_at
from ..sources.table import PARTITION_TYPES, Table, checked_cast, col, find, new_write_id, stored_name, table_schema


def create_or_replace(
    df: DataFrame,
    table: Table,
    *,
    format: str = "parquet",
    partition_by: Sequence[str] = (),
    compression: str = COMPRESSION,
    cluster: bool = True,
    ranges: Sequence[str] = (),
    zorder: Sequence[str] = (),
    before_commit: Callable[[str], None] | None = None,
) -> int:
    """Make the table hold these rows and return the version that does.

    Of the columns in ``ranges`` the list keeps bounds and NULLs for each file, at the cost
    of reading them once more; reads and changes then leave out files that cannot hold a
    row they ask for. ``zorder`` lays rows out so that rows near in all of these columns
    share files, and keeps their bounds too. ``before_commit`` is called with the id of the
    write when its files are there and the version is not.

    Later changes of the table keep its format and compression.
    Earlier versions stay readable, but the new one has no parent. ``cluster=False``
    leaves rows in the tasks they are in, for input already arranged by partition.
    """
    if format not in FORMATS:
        raise ValueError(f"format {format!r}: there are {FORMATS}")
    schema = table_schema(df.schema)
    parts = [find(schema, p) for p in partition_by]
    for f in parts:
        if not isinstance(f.dataType, PARTITION_TYPES):
            raise ValueError(f"cannot partition by {f.name}: {f.dataType.simpleString()}")
    if parts and len(parts) == len(schema):
        raise ValueError("a table needs a column that does not partition it")
    stored = tuple(stored_name(f) for f in parts)
    ranged = tuple(dict.fromkeys(stored_name(find(schema, c)) for c in (*ranges, *zorder)))
    if set(ranged) & set(stored):
        raise ValueError("a column that partitions the table has no bounds: its files hold one value")

    last = last_version(table)
    replaced = version_at(table, last) if last else None
    number = last + 1
    write_id = new_write_id(number)
    if zorder:
        df = along_curve(df, [find(schema, c).name for c in zorder], [f.name for f in parts])
    elif cluster:
        df = clustered(df, [f.name for f in parts])
    write(
        table,
        df,
        write_id=write_id,
        format=format,
        schema=schema,
        partitioned_by=stored,
        compression=compression,
    )
    if before_commit:
        before_commit(write_id)
    return commit_files(
        table,
        write_id=write_id,
        number=number,
        before=None,
        kept=None,
        wrote=True,
        operation="create" if number == 1 else "replace",
        format=format,
        schema=schema,
        partitioned_by=stored,
        compression=compression,
        ranged=ranged,
        replaced=replaced,
    )


def append(
    df: DataFrame, table: Table, *, cluster: bool = True, before_commit: Callable[[str], None] | None = None
) -> int:
    """Add rows. Columns are taken by name; those the rows lack become NULL. ``before_commit`` as in ``create_or_replace``."""
    before = version_at(table)
    have = {n.lower(): n for n in df.columns}
    extra = set(have) - {f.name.lower() for f in before.schema}
    if extra:
        raise ValueError(f"the table has no columns {sorted(extra)}")
    types = {f.name: f.dataType for f in df.schema}
    rows = df.select([_column(have.get(f.name.lower()), f, types) for f in before.schema])
    if cluster:
        rows = clustered(rows, before.partition_columns)
    write_id = new_write_id(before.number + 1)
    return write_next(table, before, write_id, "append", rows, listed(table, before), before_commit)


def write_next(
    table: Table,
    before: Version,
    write_id: str,
    operation: str,
    rows: DataFrame | None,
    kept: DataFrame | None,
    before_commit: Callable[[str], None] | None = None,
) -> int:
    """Write rows and commit them together with the files that stay, as the next version."""
    if rows is not None:
        write(
            table,
            rows,
            write_id=write_id,
            format=before.format,
            schema=before.schema,
            partitioned_by=before.partitioned_by,
            compression=before.compression,
        )
    if before_commit:
        before_commit(write_id)
    return commit_files(
        table,
        write_id=write_id,
        number=before.number + 1,
        before=before,
        kept=kept,
        wrote=rows is not None,
        operation=operation,
        format=before.format,
        schema=before.schema,
        partitioned_by=before.partitioned_by,
        compression=before.compression,
        ranged=before.ranged,
    )


def _column(name: str | None, f: T.StructField, types: dict[str, T.DataType]) -> Column:
    value = F.lit(None).cast(f.dataType) if name is None else checked_cast(col(name), f.dataType, f.name, types[name])
    return value.alias(f.name)
