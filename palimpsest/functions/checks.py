"""Checks on a table that fail the job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.table import col


class CheckFailed(AssertionError):
    def __init__(self, failures: Sequence[str]):
        super().__init__("; ".join(failures))
        self.failures = list(failures)


def count_rows(df: DataFrame) -> DataFrame:
    """One row, one column ``total``."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with how many."""
    return df.groupBy([col(k) for k in key]).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def validate(
    df: DataFrame,
    *,
    min_rows: int | None = None,
    expected_rows: int | None = None,
    not_null: Sequence[str] = (),
    unique: Sequence[str] = (),
    schema: T.StructType | str | None = None,
) -> int:
    """Count the rows and test the rules; raise CheckFailed with every rule that does not hold.

    One pass over the NOT NULL columns, and one grouping by the unique key.
    """
    failures = []
    if schema is not None:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        have = [(f.name, f.dataType.simpleString()) for f in df.schema]
        want = [(f.name, f.dataType.simpleString()) for f in schema]
        if have != want:
            failures.append(f"schema is {have}, not {want}")
    missing = [c for c in (*not_null, *unique) if c not in df.columns]
    if missing:
        raise CheckFailed([*failures, f"no columns {missing}"])

    nulls = [F.count_if(col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(not_null)]
    row = df.agg(F.count(F.lit(1)).alias("total"), *nulls).first()
    total = row["total"]
    if min_rows is not None and total < min_rows:
        failures.append(f"{total} rows, fewer than {min_rows}")
    if expected_rows is not None and total != expected_rows:
        failures.append(f"{total} rows, not {expected_rows}")
    for i, c in enumerate(not_null):
        if row[f"nulls_{i}"]:
            failures.append(f"{row[f'nulls_{i}']} NULLs in {c}")
    if unique and not repeated_keys(df, unique).isEmpty():
        failures.append(f"{list(unique)} is not unique")
    if failures:
        raise CheckFailed(failures)
    return total
