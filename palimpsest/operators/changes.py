"""The change feed: what rows a version has that another has not."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.data import load
from ..sources.files import listed, paths
from ..sources.log import Version, version_at
from ..sources.table import Table, col

CHANGE, COPIES = "change", "copies"
_WEIGHT, _KEYS = "palimpsest_weight", ("palimpsest_key_1", "palimpsest_key_2")


def _only(table: Table, of: Version, other: Version) -> list[str]:
    """What to read of a version that is in files the other does not have, or has with other rows deleted by position."""
    shared = listed(table, other).where("NOT dead").select("name", "holes", F.lit(True).alias("shared"))
    return paths(table, listed(table, of).join(shared, ["name", "holes"], "left"), F.col("shared").isNull())


def changes_between(table: Table, old: int, new: int | None = None) -> DataFrame:
    """Rows that came (``change`` is insert) and went (delete) from one version to another, each with how many ``copies``.

    Columns are those of the newer version, so that adding, dropping or renaming a column
    changes no row; a row that got other values went and came. Only files that one of the
    versions does not have are opened. Rows that were copied from file to file cancel: their
    keys, two hashes of all columns, meet first, and only rows whose keys do not cancel are moved.
    """
    before, after = version_at(table, old), version_at(table, new)
    names = after.columns.names
    taken = {CHANGE, COPIES} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the table has columns called {sorted(taken)}")
    if any(_has_map(f.dataType) for f in after.columns):
        raise ValueError("rows that hold maps cannot be compared")
    gone, come = _only(table, before, after), _only(table, after, before)
    columns = [col(n) for n in names]

    def side(version: Version, files: list[str], weight: int) -> DataFrame:
        return load(table, version, files).withColumn(_WEIGHT, F.lit(weight).cast("bigint"))

    rows = side(dataclasses.replace(after, format=before.format), gone, -1).unionByName(side(after, come, 1))
    keyed = rows.withColumns({k: F.xxhash64(F.lit(i), *columns) for i, k in enumerate(_KEYS)})
    left = keyed.groupBy(*_KEYS).agg(F.sum(_WEIGHT).alias("net")).where("net <> 0").select(*_KEYS)
    net = keyed.join(left, list(_KEYS), "left_semi").groupBy(*columns).agg(F.sum(_WEIGHT).alias(_WEIGHT)).where(f"{_WEIGHT} <> 0")
    return net.select(
        *columns,
        F.when(F.col(_WEIGHT) > 0, "insert").otherwise("delete").alias(CHANGE),
        F.abs(_WEIGHT).alias(COPIES),
    )


def _has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return True
    if isinstance(data_type, T.ArrayType):
        return _has_map(data_type.elementType)
    return isinstance(data_type, T.StructType) and any(_has_map(f.dataType) for f in data_type)
