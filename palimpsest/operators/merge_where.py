"""MERGE on any condition that compares the two sides: equalities, ranges, and what else it says.

Equalities are keys of the join. Of a range, ``t.x BETWEEN s.low AND s.high`` or only one
end of it, the source's intervals are laid in bins: each interval in those of the width
next above its own length, twice the last from level to level, so that it lies in few of
them, and every target row in one bin of each level that the source has. A pair is then
met in one bin only, by a join on equal bins, whose hot ones adaptive execution splits;
nothing is compared with everything. The narrowest width is the median length of the
source's intervals. The whole condition is asked of every pair.

A target row is known by its file and its number in it, so that matches are one table of
(file, row, source row), from which all the rest follows: the rows that match more than
one source row, the files to rewrite, and the source rows that match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import CLOCK, between, conjuncts, items, kind, parts_of
from ..functions.rows import Clause, as_condition, inserted_rows, merged_rows
from ..sources.data import clustered, load
from ..sources.files import commit_same_files, file_name, listed, paths, touching, without
from ..sources.log import Version, version_at
from ..sources.table import Table, new_write_id, plain_schema
from .change import PATH, empty_staging, stage_touched
from .merge import RepeatedSourceKey, any_true, require_clauses, stage
from .write import write_next

ROW = "palimpsest_row"
SOURCE_ROW = "palimpsest_source_row"
APPLIES = "palimpsest_applies"
LEVEL, BIN = "palimpsest_level", "palimpsest_bin"

#: Level of intervals with one end only: one bin.
OPEN = -1
TOP = 62
#: Bins are numbered by long numbers; what lies further out is in the outermost.
FURTHEST = 9.0e18

LOWER, UPPER = {"GreaterThan", "GreaterThanOrEqual"}, {"LessThan", "LessThanOrEqual"}


@dataclass
class Comparison:
    """How a condition compares the target with the source, as SQL text of either side."""

    keys: list[tuple[str, str, bool]]  # target, source, whether NULL equals NULL
    ranges: dict[str, tuple[list[str], list[str]]]  # target: lower ends, upper ends
    types: dict[str, str]


def compared(target: DataFrame, source: DataFrame, condition: Column) -> Comparison:
    """The equalities and ranges among what must all be TRUE. Analyses the condition, runs nothing."""
    try:
        plan = target.alias("t").join(source.alias("s"), condition)._jdf.queryExecution().analyzed()
    except AnalysisException as e:
        if e.getCondition() == "INVALID_NON_DETERMINISTIC_EXPRESSIONS":
            raise ValueError("the condition must give the same answer every time it is asked") from e
        raise
    while kind(plan) != "Join":
        plan = plan.child()
    expression, left, right = plan.condition().get(), plan.left().outputSet(), plan.right().outputSet()
    if any(kind(e) in CLOCK for e in parts_of(expression)):
        raise ValueError("the condition asks the clock; put the time in as a literal")
    out = Comparison([], {}, {})

    def of(side: JavaObject, e: JavaObject) -> bool:
        refs = e.references()
        return refs.nonEmpty() and refs.subsetOf(side)

    def end(t: JavaObject, s: JavaObject, lower: bool) -> None:
        out.ranges.setdefault(t.sql(), ([], []))[0 if lower else 1].append(s.sql())
        out.types[t.sql()] = t.dataType().typeName()

    for e in conjuncts(expression):
        what = kind(e)
        if what == "Between":
            value, low, high = between(e)
            if of(left, value):
                for bound, lower in ((low, True), (high, False)):
                    if of(right, bound):
                        end(value, bound, lower)
            elif of(right, value):
                for bound, lower in ((low, False), (high, True)):
                    if of(left, bound):
                        end(bound, value, lower)
            continue
        if what not in {"EqualTo", "EqualNullSafe", *LOWER, *UPPER}:
            continue
        a, b = items(e.children())
        if not (of(left, a) and of(right, b)):
            if not (of(left, b) and of(right, a)):
                continue
            a, b = b, a
            what = {"GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual", "LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual"}.get(what, what)
        if what in ("EqualTo", "EqualNullSafe"):
            out.keys.append((a.sql(), b.sql(), what == "EqualNullSafe"))
        else:
            end(a, b, what in LOWER)
    return out


def _place(sql: str, type_name: str) -> Column | None:
    """A value as a double that keeps the order; None for types without one."""
    if type_name == "date":
        return F.unix_date(F.expr(sql)).cast("double")
    if type_name == "timestamp":
        return F.unix_micros(F.expr(sql)).cast("double")
    if type_name == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {sql})").cast("double")
    if type_name.startswith("decimal") or type_name in ("byte", "short", "integer", "long", "float", "double", "tinyint", "smallint", "int", "bigint"):
        place = F.expr(sql).cast("double")
        return F.when(F.isnan(place), F.lit(float("inf"))).otherwise(place)  # NaN is above all numbers
    return None


def _bin(place: Column, width: Column) -> Column:
    return F.floor(F.greatest(F.least(place / width, F.lit(FURTHEST)), F.lit(-FURTHEST)))


def _range_of(comparison: Comparison) -> tuple[Column, list[Column], list[Column]] | None:
    """The range to lay in bins: one with both ends where there is one."""
    usable = []
    for t, (lows, highs) in comparison.ranges.items():
        place = _place(t, comparison.types[t])
        if place is not None:
            ends = [[_place(s, comparison.types[t]) for s in side] for side in (lows, highs)]
            usable.append((bool(lows) + bool(highs), place, *ends))
    if not usable:
        return None
    return max(usable, key=lambda x: x[0])[1:]


def in_bins(target: DataFrame, source: DataFrame, comparison: Comparison) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides as ``t`` and ``s`` with the keys and bins of the join, and the join's equalities."""
    same = F.lit(True)
    target, source = target.alias("t"), source.alias("s")
    t_more, s_more = {}, {}
    for i, (t, s, nulls) in enumerate(comparison.keys):
        name = f"palimpsest_key_{i}"
        t_more[name], s_more[name] = F.expr(t), F.expr(s)
        a, b = F.col(f"t.{name}"), F.col(f"s.{name}")
        same = same & (a.eqNullSafe(b) if nulls else a == b)
    found = _range_of(comparison)
    if found is None:
        if not comparison.keys:
            raise ValueError("a merge needs an equality or a range of numbers, dates or times between the table and the source")
        return target.withColumns(t_more).alias("t"), source.withColumns(s_more).alias("s"), same
    place, lows, highs = found
    low = F.greatest(*lows) if len(lows) > 1 else lows[0] if lows else F.lit(float("-inf"))
    high = F.least(*highs) if len(highs) > 1 else highs[0] if highs else F.lit(float("inf"))
    source = source.withColumns({**s_more, "palimpsest_low": low, "palimpsest_high": high})
    source = source.where("palimpsest_low <= palimpsest_high")
    length = F.col("palimpsest_high") - F.col("palimpsest_low")
    finite = F.when(length < FURTHEST, length)
    facts = source.agg(
        F.percentile_approx(finite, 0.5).alias("median"),
        F.max("palimpsest_high").alias("last"),
        F.min("palimpsest_low").alias("first"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    width = facts["median"] or 0.0
    if not width > 0:  # points: as many bins as there are of them
        spread = (facts["last"] or 0.0) - (facts["first"] or 0.0)
        width = spread / max(facts["n"], 1) if 0 < spread < FURTHEST else 1.0
    steps = F.ceil(F.log2(F.greatest(F.col("palimpsest_high") - F.col("palimpsest_low"), F.lit(width)) / width))
    level = F.when(length < FURTHEST, F.least(steps, F.lit(TOP))).otherwise(F.lit(OPEN)).cast("int")
    source = source.withColumn(LEVEL, level)
    levels = sorted(r[0] for r in source.select(LEVEL).distinct().collect())  # 64 at most
    wide = F.lit(width) * F.pow(F.lit(2.0), F.col(LEVEL))
    last, first = _bin(F.col("palimpsest_high"), wide), _bin(F.col("palimpsest_low"), wide)
    bins = F.when(F.col(LEVEL) == OPEN, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(first, last))
    source = source.withColumn(BIN, F.explode(bins)).drop("palimpsest_low", "palimpsest_high")
    places = [
        F.struct(
            F.lit(n).alias("level"),
            (F.lit(0).cast("bigint") if n == OPEN else _bin(F.col("palimpsest_place"), F.lit(width * 2.0**n))).alias("bin"),
        )
        for n in levels
    ] or [F.struct(F.lit(OPEN).alias("level"), F.lit(0).cast("bigint").alias("bin"))]
    target = target.withColumns({**t_more, "palimpsest_place": place}).where("palimpsest_place IS NOT NULL")
    target = target.withColumn("palimpsest_at", F.explode(F.array(*places)))
    target = target.withColumns({LEVEL: F.col("palimpsest_at.level"), BIN: F.col("palimpsest_at.bin")})
    target = target.drop("palimpsest_at", "palimpsest_place")
    same = same & (F.col(f"t.{LEVEL}") == F.col(f"s.{LEVEL}")) & (F.col(f"t.{BIN}") == F.col(f"s.{BIN}"))
    return target.alias("t"), source.alias("s"), same


def _numbered(table: Table, version: Version, from_paths: list[str], write_id: str) -> DataFrame:
    """The rows with their file and their number in it. ORC has no numbers: its rows get theirs in a written copy."""
    if version.format == "parquet":
        return load(table, version, from_paths, PATH, ROW)
    rows = load(table, version, from_paths, PATH).withColumn(ROW, F.monotonically_increasing_id())
    return stage(table, rows, write_id, "numbered")


def merge_where(
    table: Table,
    source: DataFrame,
    condition: Column | str,
    *,
    matched: Sequence[Clause] = (),
    not_matched: Sequence[Clause] = (),
    not_matched_by_source: Sequence[Clause] = (),
) -> int:
    """Merge a source into the table on a condition over ``t.x`` and ``s.x``; return the new version.

    Of what must all be TRUE, at least one part is an equality between the two sides or
    bounds a number, date or time of the table by the source. Clauses are as in ``merge``.
    A row that matches more than one source row fails the merge, unless it is deleted
    whichever is meant.
    """
    before = version_at(table)
    schema = plain_schema(before.schema)
    require_clauses(matched, not_matched, not_matched_by_source)
    condition = as_condition(condition)
    write_id = new_write_id(before.number + 1)
    source = stage(table, source.withColumn(SOURCE_ROW, F.monotonically_increasing_id()), write_id, "source")
    files = listed(table, before)
    rows = _numbered(table, before, paths(table, files), write_id)

    t, s, same = in_bins(rows, source, compared(rows, source, condition))
    applies = any_true(matched) if matched else F.lit(False)
    pairs = t.join(s, same & condition).select(
        F.col(f"t.{PATH}"), F.col(f"t.{ROW}"), *[F.col(f"s.`{c}`") for c in source.columns], applies.alias(APPLIES)
    )
    pairs = stage(table, pairs, write_id, "pairs")
    if matched:
        twice = pairs.groupBy(PATH, ROW).count().where("count > 1")
        if matched[0].action != "delete" or matched[0].condition is not None:
            found = twice.first()
            if found is not None:
                raise RepeatedSourceKey(f"{found['count']} source rows match one target row, number {found[ROW]} of {found[PATH]}")
    hits = pairs.where(APPLIES).select(PATH)
    if not_matched_by_source:
        alone = rows.alias("t").join(pairs.select(PATH, ROW).alias("p"), [PATH, ROW], "left_anti")
        hits = hits.unionByName(alone.where(any_true(not_matched_by_source)).select(PATH))
    touched = stage_touched(table, hits, write_id)
    again = paths(table, touching(files, touched), F.col("matched").isNotNull())

    parts = []
    if again:
        if before.format == "parquet":
            current = _numbered(table, before, again, write_id)
        else:
            names = touched.select(F.col("name").alias("palimpsest_name"))
            current = rows.join(names, file_name(F.col(PATH)) == F.col("palimpsest_name"), "left_semi")
        # A row that is there more than once is deleted whichever is meant, or is only asked whether it matches.
        one = pairs.drop(APPLIES, SOURCE_ROW).dropDuplicates([PATH, ROW])
        one = one.withColumnsRenamed({PATH: "palimpsest_of_path", ROW: "palimpsest_of_row"})
        on = (F.col(f"t.{PATH}") == F.col("s.palimpsest_of_path")) & (F.col(f"t.{ROW}") == F.col("s.palimpsest_of_row"))
        parts.append(merged_rows(current, one, on, matched, not_matched_by_source, schema))
    if not_matched:
        rest = source.join(pairs.select(SOURCE_ROW).distinct(), SOURCE_ROW, "left_anti").drop(SOURCE_ROW)
        parts.append(inserted_rows(rest, schema, not_matched))
    if not parts:
        version = commit_same_files(table, before, "merge")
    else:
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out = clustered(out, before.partition_columns)
        version = write_next(table, before, write_id, "merge", out, without(files, touched))
    empty_staging(table, write_id)
    return version
