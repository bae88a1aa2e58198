"""What UPDATE, DELETE and MERGE do to rows. Plain DataFrame code, no reading or writing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.table import checked_cast, col, find

MATCHED = "palimpsest_matched"
CLAUSE = "palimpsest_clause"


def as_condition(condition: Column | str) -> Column:
    """A condition given as a Column or as SQL text."""
    return F.expr(condition) if isinstance(condition, str) else condition


def as_value(value: Any) -> Column:
    """An assigned value: a Column, SQL text, or a plain number, date or None."""
    if isinstance(value, Column):
        return value
    return F.expr(value) if isinstance(value, str) else F.lit(value)


def updated(rows: DataFrame, condition: Column | str, assignments: Mapping[str, Any]) -> DataFrame:
    """Rows where the condition is TRUE get new values, the others stay.

    Every right side sees the old row, and every column keeps its type. A condition on
    ``IN (SELECT ...)`` or ``EXISTS``, which Spark takes in a filter only, splits the rows.
    """
    condition = as_condition(condition)
    values = {}
    for name, value in assignments.items():
        f = find(rows.schema, name)
        if f.name in values:
            raise ValueError(f"column {f.name!r} is assigned twice")
        values[f.name] = checked_cast(as_value(value), f.dataType, f.name)
    changes = {n: F.when(condition, v).otherwise(col(n)) for n, v in values.items()}
    try:
        return rows.select([changes[n].alias(n) if n in changes else col(n) for n in rows.columns])
    except AnalysisException as e:
        if not (e.getCondition() or "").startswith("UNSUPPORTED_SUBQUERY_EXPRESSION_CATEGORY"):
            raise
    hit = rows.where(condition).select([values[n].alias(n) if n in values else col(n) for n in rows.columns])
    return hit.unionByName(deleted(rows, condition))


def deleted(rows: DataFrame, condition: Column | str) -> DataFrame:
    """Rows where the condition is not TRUE: FALSE and NULL both stay."""
    return rows.where(~F.coalesce(as_condition(condition), F.lit(False)))


@dataclass(frozen=True)
class Clause:
    action: str
    condition: Column | str | None = None
    values: Mapping[str, Any] | None = None


def set_columns(values: Mapping[str, Any] | None = None, condition: Column | str | None = None) -> Clause:
    """Update the row. No values: every column from the source column of its name.

    Conditions and values name target columns ``t.x`` and source columns ``s.x``.
    """
    return Clause("update", condition, values)


def remove_row(condition: Column | str | None = None) -> Clause:
    return Clause("delete", condition)


def insert_row(values: Mapping[str, Any] | None = None, condition: Column | str | None = None) -> Clause:
    """Insert the source row. Columns without a value are NULL. No values: by name."""
    return Clause("insert", condition, values)


def _first_true(tests: Sequence[tuple[Column, Clause]]) -> Column:
    """Number of the first clause that applies, NULL where none does."""
    chosen = F.lit(None).cast("int")
    for i, (applies, clause) in reversed(list(enumerate(tests))):
        if clause.condition is not None:
            applies = applies & F.coalesce(as_condition(clause.condition), F.lit(False))
        chosen = F.when(applies, F.lit(i)).otherwise(chosen)
    return chosen


def _values(clause: Clause, schema: T.StructType, source: Sequence[str]) -> dict[str, Column]:
    """Assigned values of a clause by column of the table, cast to its type."""
    if clause.values is None:
        have = {n.lower(): n for n in source}
        missing = [f.name for f in schema if f.name.lower() not in have]
        if missing:
            raise ValueError(f"the source has no columns {missing}; give the values")
        return {f.name: checked_cast(col(have[f.name.lower()], of="s"), f.dataType, f.name) for f in schema}
    out = {}
    for name, value in clause.values.items():
        f = find(schema, name)
        if f.name in out:
            raise ValueError(f"column {f.name!r} is assigned twice")
        out[f.name] = checked_cast(as_value(value), f.dataType, f.name)
    return out


def merged_rows(
    target: DataFrame,
    source: DataFrame,
    on: Column,
    matched: Sequence[Clause],
    not_matched_by_source: Sequence[Clause],
    schema: T.StructType | None = None,
) -> DataFrame:
    """Target rows after the clauses for rows that are there already.

    A left join from the target, so a key that much of the target shares can be
    cut by adaptive execution, which a full outer join does not allow. The source
    must not hold a key twice. ``schema`` names the columns to keep.
    """
    schema = schema or target.schema
    joined = target.alias("t").join(source.withColumn(MATCHED, F.lit(True)).alias("s"), on, "left")
    hit = F.col(f"s.{MATCHED}").isNotNull()
    clauses = [(hit, c) for c in matched] + [(~hit, c) for c in not_matched_by_source]
    values = [_values(c, schema, source.columns) if c.action == "update" else {} for _, c in clauses]
    deletes = [i for i, (_, c) in enumerate(clauses) if c.action == "delete"]

    rows = joined.withColumn(CLAUSE, _first_true(clauses))
    if deletes:
        rows = rows.where(~F.coalesce(F.col(CLAUSE).isin(deletes), F.lit(False)))
    out = []
    for f in schema:
        value = col(f.name, of="t")
        for i, assigned in enumerate(values):
            if f.name in assigned:
                value = F.when(F.col(CLAUSE) == i, assigned[f.name]).otherwise(value)
        out.append(value.alias(f.name))
    return rows.select(out)


def inserted_rows(source: DataFrame, schema: T.StructType, not_matched: Sequence[Clause]) -> DataFrame:
    """Rows to insert for source rows that match nothing."""
    rows = source.alias("s").withColumn(CLAUSE, _first_true([(F.lit(True), c) for c in not_matched]))
    values = [_values(c, schema, source.columns) for c in not_matched]
    out = []
    for f in schema:
        value = F.lit(None).cast(f.dataType)
        for i, assigned in enumerate(values):
            if f.name in assigned:
                value = F.when(F.col(CLAUSE) == i, assigned[f.name]).otherwise(value)
        out.append(value.alias(f.name))
    return rows.where(F.col(CLAUSE).isNotNull()).select(out)
