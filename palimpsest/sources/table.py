"""Where a table lives and what its columns are called on storage.

A table is a folder::

    <root>/<namespace>/<name>/
        data/write_id=<id>/[<column>=<value>/...]part-*   data files, never changed
        files/<id>/part-*                                  the data files of one version
        log/version=<n>/part-*                             one row per version
        holes/<id>/part-*                                  rows deleted by their number in a file

``root`` is any URI Spark can read and write (``s3a://``, ``hdfs://``, ``file:``).
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WRITE_ID = "write_id"
STORED_AS = "palimpsest.stored_as"

PARTITION_TYPES = (
    T.StringType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.DateType,
    T.BooleanType,
)

_NAME = re.compile(r"[A-Za-z0-9_]+")


@dataclass(frozen=True)
class Table:
    """A versioned table: a session, a root folder, a namespace and a name."""

    spark: SparkSession = field(repr=False, compare=False)
    root: str
    namespace: str
    name: str

    def __post_init__(self) -> None:
        for part in (self.namespace, self.name):
            if not _NAME.fullmatch(part):
                raise ValueError(f"not a valid name: {part!r}")

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.namespace}/{self.name}"

    @property
    def data(self) -> str:
        return f"{self.path}/data"

    @property
    def log(self) -> str:
        return f"{self.path}/log"

    def data_dir(self, write_id: str) -> str:
        return f"{self.data}/{WRITE_ID}={write_id}"

    def files_dir(self, write_id: str) -> str:
        return f"{self.path}/files/{write_id}"

    def holes_dir(self, write_id: str) -> str:
        return f"{self.path}/holes/{write_id}"

    def log_dir(self, version: int) -> str:
        return f"{self.log}/version={version}"

    def staging_dir(self, write_id: str, what: str = "") -> str:
        """Shared folder for an intermediate result of one write, or for all of them.

        Uses the folder the cluster names in ``spark.checkpoint.dir``; where it
        is unset, the table's own folder, which every executor reaches too.
        """
        shared = self.spark.conf.get("spark.checkpoint.dir", None)
        base = f"{shared.rstrip('/')}/{self.namespace}/{self.name}" if shared else f"{self.path}/staging"
        return f"{base}/{write_id}/{what}".rstrip("/")


def new_write_id(version: int) -> str:
    """Never reused, so what a crashed write left behind is never picked up."""
    return f"v{version}-{uuid.uuid4().hex}"


def empty_folder(spark: SparkSession, path: str) -> None:
    """Remove what is in a folder of intermediate results, by the file system Spark uses for it. Runs no job."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for child in files.listStatus(at) if files.exists(at) else ():
        files.delete(child.getPath(), True)


# Columns are stored under names that never change, so RENAME touches no data
# and a column added under a dropped column's name does not bring old values back.


def stored_name(column: T.StructField) -> str:
    return (column.metadata or {}).get(STORED_AS, column.name)


def new_column(name: str, data_type: T.DataType, fresh: bool) -> T.StructField:
    """``fresh`` asks for a stored name nothing has used before."""
    fresh = fresh or name.lower() == WRITE_ID
    metadata = {STORED_AS: f"{name}_{uuid.uuid4().hex[:12]}"} if fresh else {}
    return T.StructField(name, data_type, True, metadata)


def table_schema(schema: T.StructType) -> T.StructType:
    names = [f.name.lower() for f in schema]
    repeated = {n for n in names if names.count(n) > 1}
    if repeated:
        raise ValueError(f"columns named more than once: {sorted(repeated)}")
    return T.StructType([new_column(f.name, f.dataType, fresh=False) for f in schema])


def stored_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(stored_name(f), f.dataType, True) for f in schema])


def plain_schema(schema: T.StructType) -> T.StructType:
    """The schema users see: names and types only."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def find(schema: T.StructType, name: str) -> T.StructField:
    for f in schema:
        if f.name.lower() == name.lower():
            return f
    raise ValueError(f"no column {name!r}; there are {schema.names}")


def col(name: str, of: str | None = None) -> Column:
    """Column by its exact name, dots and all."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def checked_cast(value: Column, to: T.DataType, what: str, old: T.DataType | None = None) -> Column:
    """The value in another type; one that does not fit fails the job, whatever ``spark.sql.ansi.enabled`` says.

    With the type it had, a value that would lose a part fails too: digits after the point,
    digits of a number, the time of a day. Without, values are assigned as SQL does it.
    Arrays, maps and structs are cast as Spark does it.
    """
    if isinstance(to, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.NullType)):
        return value.cast(to)
    fits = value.try_cast(to)
    message = F.concat(F.lit(f"{what}: not a {to.simpleString()}: "), value.cast("string"))
    bad = value.isNotNull() & fits.isNull()
    if old is not None and old != to:
        bad = bad | _cut(value, fits, old, to)
    return F.when(bad, F.raise_error(message)).otherwise(fits)


_WHOLE = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _cut(value: Column, fits: Column, old: T.DataType, to: T.DataType) -> Column:
    """Whether the value has lost a part: cast back it is another one."""
    if isinstance(old, (T.StringType, T.CharType, T.VarcharType)):
        # A text says its value in many ways: it is held against the widest type of the kind.
        widest = {T.DecimalType: "decimal(38,18)", T.DateType: "timestamp_ntz"}.get(type(to))
        return F.coalesce(value.try_cast(widest) != fits.cast(widest), F.lit(False)) if widest else F.lit(False)
    if isinstance(old, _WHOLE) and isinstance(to, _WHOLE):
        return value.isNotNull() & ~fits.try_cast(old).eqNullSafe(value)
    return F.lit(False)


def to_stored(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by their stored names. Where a type differs, values are checked as they are cast."""
    have = {f.name: f.dataType for f in df.schema}
    return df.select(
        [
            (col(f.name) if have[f.name] == f.dataType else checked_cast(col(f.name), f.dataType, f.name, have[f.name])).alias(
                stored_name(f)
            )
            for f in schema
        ]
    )
