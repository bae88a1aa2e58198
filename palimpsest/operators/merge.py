"""MERGE: update, delete and insert by comparing a table with a source on key columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import Clause, as_condition, inserted_rows, merged_rows
from ..sources.data import clustered, load, scan
from ..sources.files import commit_same_files, listed, paths, touching, without
from ..sources.log import Version, version_at
from ..sources.table import Table, col, find, new_write_id, plain_schema
from .change import PATH, by_mark, empty_staging, stage_touched
from .write import write_next

RANGE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.StringType)

_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


class RepeatedSourceKey(ValueError):
    """A target row matches more than one source row, so its new value is not defined."""


def merge(
    table: Table,
    source: DataFrame,
    on: str | Sequence[str] | Mapping[str, str],
    *,
    matched: Sequence[Clause] = (),
    not_matched: Sequence[Clause] = (),
    not_matched_by_source: Sequence[Clause] = (),
) -> int:
    """Merge a source into the table; return the new version.

    ``on`` names the key columns (a mapping where the source calls them something
    else). NULL keys match nothing. Of the clauses of a kind the first whose
    condition is TRUE applies; a row for which none applies stays as it is.
    """
    before = version_at(table)
    schema = plain_schema(before.schema)
    pairs = _pairs(on, schema, source)
    require_clauses(matched, not_matched, not_matched_by_source)

    write_id = new_write_id(before.number + 1)
    keys = [f"k{i}" for i in range(len(pairs))]
    source = stage(table, source, write_id, "source")
    source_keys = source.select([col(s).alias(k) for (_, s), k in zip(pairs, keys, strict=True)])
    source_keys = source_keys.where(_all([F.col(k).isNotNull() for k in keys]))  # NaN is a key like any other
    facts = _facts(source, pairs)
    limit = _broadcast_limit(table)
    repeated = facts["most"] > 1
    once = stage(table, source_keys.distinct(), write_id, "keys") if repeated else source_keys
    # Source rows of one key may differ where it does not matter which of them is meant.
    choice = repeated and bool(matched) and (matched[0].action != "delete" or matched[0].condition is not None)

    files = listed(table, before)
    find_keys = bool(not_matched) or choice
    always = any(c.condition is None for c in matched)
    small_keys = facts["key_bytes"] <= limit
    wanted = F.broadcast(once) if small_keys else once
    found, hit_keys = [], None  # rows with the PATH of a file in which a clause may apply
    target_keys = _target_keys(table, before, pairs, source_keys, facts, path_as=PATH)
    if small_keys and find_keys:
        # One pass over the target's keys gives both the keys and the files hit.
        hits = target_keys.join(wanted, keys, "left_semi")
        hits = stage(table, hits.groupBy(*keys, PATH).count(), write_id, "hits")
        hit_keys = hits.select(keys).distinct()
        if always:
            found.append(hits.select(PATH))
    else:
        if always:
            found.append(target_keys.join(wanted, keys, "left_semi").select(PATH))
        if find_keys:
            # One row per key and task before the shuffle, however many rows share the key.
            only_keys = _target_keys(table, before, pairs, source_keys, facts, path_as=None)
            hit_keys = stage(table, only_keys.distinct().join(once, keys, "left_semi"), write_id, "hits")
    if matched and not always:
        # Every clause has a condition: only files count that hold a row for which one is TRUE.
        rows = by_mark(_in_range(scan(table, before, PATH), pairs, source_keys, facts)).alias("t")
        other = F.broadcast(source) if facts["row_bytes"] <= limit else source
        applies = _equal([(col(t, of="t"), col(s, of="s")) for t, s in pairs]) & any_true(matched)
        found.append(rows.join(other.alias("s"), applies, "left_semi").select(F.col(f"t.{PATH}").alias(PATH)))
    if not_matched_by_source:
        rows = by_mark(scan(table, before, PATH)).alias("t")
        same = _equal([(col(t, of="t"), F.col(f"k.{k}")) for (t, _), k in zip(pairs, keys, strict=True)])
        rows = rows.join(wanted.alias("k"), same, "left_anti").where(any_true(not_matched_by_source))
        found.append(rows.select(F.col(f"t.{PATH}").alias(PATH)))
    touched = None
    if found:
        hits = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        touched = stage_touched(table, hits, write_id, files)

    matching = once.toDF(*[s for _, s in pairs]) if repeated else source
    if choice:
        _require_single_matches(source_keys, hit_keys)
        matching = stage(table, _on_hits(source, pairs, hit_keys, "left_semi"), write_id, "matching")

    if touched is not None:
        again = paths(table, touching(files, touched), F.col("matched").isNotNull())
        kept = without(files, touched)
    else:
        again, kept = [], files

    # With a source small enough to broadcast, rows stay in the tasks that read them, which
    # hold few partitions each, unless they are inserted or go to another partition.
    small = facts["row_bytes"] <= limit
    assigned = {find(schema, c).name for clause in (*matched, *not_matched_by_source) for c in clause.values or ()}
    stay = small and not assigned & set(before.partition_columns)

    parts = []
    if again:
        current = load(table, before, again)
        on_keys = _equal([(col(t, of="t"), col(s, of="s")) for t, s in pairs])
        other = F.broadcast(matching) if small else matching
        if stay and any(c.action == "update" and c.values is None for c in matched):
            stay = not _moves(current, other, on_keys, before.partition_columns)
        parts.append(merged_rows(current, other, on_keys, matched, not_matched_by_source))
    if not_matched:
        rows = inserted_rows(_on_hits(source, pairs, hit_keys, "left_anti"), schema, not_matched)
        parts.append(clustered(rows, before.partition_columns) if stay else rows)
    if not parts:
        version = commit_same_files(table, before, "merge")
        empty_staging(table, write_id)
        return version
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if not stay:
        rows = clustered(rows, before.partition_columns)
    version = write_next(table, before, write_id, "merge", rows, kept)
    empty_staging(table, write_id)
    return version


def _pairs(on, schema: T.StructType, source: DataFrame) -> list[tuple[str, str]]:
    """(target column, source column) of each key."""
    if isinstance(on, str):
        on = [on]
    pairs = on.items() if isinstance(on, Mapping) else [(c, c) for c in on]
    pairs = [(find(schema, t).name, find(source.schema, s).name) for t, s in pairs]
    if not pairs:
        raise ValueError("a merge needs key columns")
    return pairs


def require_clauses(
    matched: Sequence[Clause], not_matched: Sequence[Clause], not_matched_by_source: Sequence[Clause]
) -> None:
    _require_actions("matched", matched, {"update", "delete"})
    _require_actions("not_matched", not_matched, {"insert"})
    _require_actions("not_matched_by_source", not_matched_by_source, {"update", "delete"})
    if any(c.action == "update" and c.values is None for c in not_matched_by_source):
        raise ValueError("not_matched_by_source has no source row to take values from; give the values")
    if not (matched or not_matched or not_matched_by_source):
        raise ValueError("a merge needs a clause")


def _require_actions(kind: str, clauses: Sequence[Clause], allowed: set[str]) -> None:
    if any(c.condition is None for c in clauses[:-1]):
        raise ValueError(f"only the last clause of {kind} can go without a condition")
    for c in clauses:
        if c.action not in allowed:
            raise ValueError(f"{c.action} is not allowed in {kind}")


def _all(conditions: Sequence[Column]) -> Column:
    first, *rest = conditions
    for c in rest:
        first = first & c
    return first


def _equal(pairs: Sequence[tuple[Column, Column]]) -> Column:
    return _all([a == b for a, b in pairs])


def stage(table: Table, df: DataFrame, write_id: str, what: str) -> DataFrame:
    """Write once what several jobs read, so that all of them see the same rows."""
    at = table.staging_dir(write_id, what)
    untyped = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    df = df.withColumns({c: F.lit(None).cast("string") for c in untyped}) if untyped else df
    df.write.parquet(at)
    return table.spark.read.schema(df.schema).parquet(at)


SIZED_TYPES = (
    T.StringType,
    T.BinaryType,
    T.NumericType,
    T.BooleanType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
)


def _width(f: T.StructField) -> Column:
    """Bytes a value takes in memory, its place in the row included."""
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col(f.name)), F.lit(0)).cast("bigint") + 24
    return F.lit(24).cast("bigint")


def _facts(source: DataFrame, pairs: Sequence[tuple[str, str]]) -> dict:
    """How often the commonest source key occurs, the size of keys and rows, and the ranges of the keys."""
    fields = {f.name: f for f in source.schema}
    key_width = sum((_width(fields[s]) for _, s in pairs), F.lit(0))
    row_width = sum((_width(f) for f in source.schema), F.lit(0))
    keys = [f"k{i}" for i in range(len(pairs))]
    per_key = (
        source.select(
            [col(s).alias(k) for (_, s), k in zip(pairs, keys, strict=True)]
            + [key_width.alias("key_width"), row_width.alias("row_width")]
        )
        .groupBy(keys)
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("key_width").alias("keys"), F.sum("row_width").alias("all"))
    )
    ranges = []
    for k, (_, s) in zip(keys, pairs, strict=True):
        if isinstance(fields[s].dataType, RANGE_TYPES):
            ranges += [F.min(k).alias(f"min_{k}"), F.max(k).alias(f"max_{k}")]
    known = _all([F.col(k).isNotNull() for k in keys])
    row = per_key.agg(
        F.coalesce(F.max(F.when(known, F.col("rows"))), F.lit(0)).alias("most"),
        F.coalesce(F.sum("keys"), F.lit(0)).alias("key_bytes"),
        F.coalesce(F.sum("all"), F.lit(0)).alias("row_bytes"),
        *ranges,
    )
    facts = row.first().asDict()
    if not all(isinstance(f.dataType, SIZED_TYPES) for f in source.schema):
        facts["row_bytes"] = float("inf")  # arrays and the like can be of any size
    return facts


def _broadcast_limit(table: Table) -> int:
    """Spark's own limit for broadcasting a side of a join, in bytes."""
    text = table.spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", text).groups()
    return int(number) * _UNITS[unit]


def _target_keys(
    table: Table,
    before: Version,
    pairs: Sequence[tuple[str, str]],
    source_keys: DataFrame,
    facts: dict,
    path_as: str | None,
) -> DataFrame:
    """Keys, and on demand the file, of every target row that may match.

    Rows outside the range of the source's keys cannot, and the reader skips the
    row groups and partitions that hold only such rows.
    """
    rows = _in_range(scan(table, before, path_as), pairs, source_keys, facts)
    rows = by_mark(rows) if path_as else rows
    keys = [col(t).alias(f"k{i}") for i, (t, _) in enumerate(pairs)]
    return rows.select(keys + ([F.col(path_as)] if path_as else []))


def _in_range(rows: DataFrame, pairs: Sequence[tuple[str, str]], source_keys: DataFrame, facts: dict) -> DataFrame:
    for i, (t, _) in enumerate(pairs):
        low = facts.get(f"min_k{i}")
        if low is not None and rows.schema[t].dataType == source_keys.schema[f"k{i}"].dataType:
            rows = rows.where(col(t).between(F.lit(low), F.lit(facts[f"max_k{i}"])))
    return rows


def any_true(clauses: Sequence[Clause]) -> Column:
    """Whether one of the clauses applies."""
    out = F.lit(False)
    for c in clauses:
        out = out | (F.lit(True) if c.condition is None else F.coalesce(as_condition(c.condition), F.lit(False)))
    return out


def _moves(target: DataFrame, source: DataFrame, on: Column, columns: Sequence[str]) -> bool:
    """Whether taking these columns from the source changes any of them.

    Of partition columns nothing is read, their values are in the paths: only the keys are.
    """
    if not columns:
        return False
    same = [col(c, of="t").eqNullSafe(col(find(source.schema, c).name, of="s")) for c in columns]
    return not target.alias("t").join(source.alias("s"), on).where(~_all(same)).isEmpty()


def _on_hits(source: DataFrame, pairs: Sequence[tuple[str, str]], hit_keys: DataFrame, how: str) -> DataFrame:
    """Source rows whose key is, or is not, among the keys hit."""
    match = _equal([(col(s, of="s"), F.col(f"h.k{i}")) for i, (_, s) in enumerate(pairs)])
    return source.alias("s").join(hit_keys.alias("h"), match, how)


def _require_single_matches(source_keys: DataFrame, hit_keys: DataFrame) -> None:
    keys = source_keys.columns
    repeated = source_keys.groupBy(keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    row = repeated.join(hit_keys, keys, "left_semi").first()
    if row is not None:
        raise RepeatedSourceKey(f"{row['rows']} source rows match one target row, key {[row[k] for k in keys]}")
