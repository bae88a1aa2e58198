"""Profiles of versions: sketches of columns, kept beside the version, that can be merged and compared.

Of a number, date or time a KLL sketch keeps the quantiles, of a key a theta sketch the
distinct values. Both are of a fixed size whatever the table's, so that today's version is
held against yesterday's without reading either. A version that only adds files to one
with a profile reads just those files and merges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import CheckFailed
from ..sources.data import load
from ..sources.files import listed, paths
from ..sources.log import Version, version_at
from ..sources.table import Table, col, find

#: Size of a KLL sketch: a rank is off by less than RANK_ERROR of the rows with 99 % confidence.
KLL_SIZE = 800
RANK_ERROR = 0.005
#: Logarithm of the size of a theta sketch: up to 2^14 distinct values are counted exactly, more with this relative standard error.
THETA_LOG_SIZE = 14
THETA_ERROR = 2.0 ** (-THETA_LOG_SIZE / 2)

PROFILE_SCHEMA = "column string, kind string, rows bigint, nulls bigint, sketch binary"
#: Shares at which the quantiles of two sketches are compared; adds half a step to the error of a rank.
GRID = 400
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


class UnknownProfile(LookupError):
    pass


def _place(f: T.StructField) -> Column:
    """A value as a double in the same order."""
    value = col(f.name)
    if isinstance(f.dataType, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(f.dataType, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(f.dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value).cast("double")
    if isinstance(f.dataType, T.NumericType):
        return value.cast("double")
    raise ValueError(f"no quantiles of {f.name}: {f.dataType.simpleString()}")


def profiled(rows: DataFrame, numbers: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """One row for each sketch: counts of rows and NULLs, and the sketch; one pass over the rows, aggregated in the tasks.

    NaN has no place among the quantiles and is not in them.
    """
    wanted = [("quantiles", find(rows.schema, c)) for c in numbers] + [("keys", find(rows.schema, c)) for c in keys]
    if not wanted:
        raise ValueError("a profile needs a column")
    facts, out = [F.count(F.lit(1)).alias("rows")], []
    for i, (kind, f) in enumerate(wanted):
        if kind == "quantiles":
            place = _place(f)
            sketch = F.kll_sketch_agg_double(F.when(~F.isnan(place), place), F.lit(KLL_SIZE))
        else:
            sketch = F.theta_sketch_agg(F.when(col(f.name).isNotNull(), F.xxhash64(col(f.name))), F.lit(THETA_LOG_SIZE))
        facts += [F.count_if(col(f.name).isNull()).alias(f"nulls_{i}"), sketch.alias(f"sketch_{i}")]
        out.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(kind).alias("kind"),
                F.col("rows"),
                F.col(f"nulls_{i}").alias("nulls"),
                F.col(f"sketch_{i}").alias("sketch"),
            )
        )
    return rows.agg(*facts).select(F.inline(F.array(*out)))


def merged_profiles(one: DataFrame, other: DataFrame) -> DataFrame:
    """The profile of the rows of both."""
    a, b = one.alias("a"), other.alias("b")
    both = a.join(b, (F.col("a.column") == F.col("b.column")) & (F.col("a.kind") == F.col("b.kind")))
    sketch = F.when(F.col("a.kind") == "quantiles", F.kll_sketch_merge_double("a.sketch", "b.sketch")).otherwise(
        F.theta_union("a.sketch", "b.sketch", THETA_LOG_SIZE)
    )
    return both.select(
        "a.column",
        "a.kind",
        (F.col("a.rows") + F.col("b.rows")).alias("rows"),
        (F.col("a.nulls") + F.col("b.nulls")).alias("nulls"),
        sketch.alias("sketch"),
    )


def _folder(table: Table, version: Version) -> str:
    return f"{table.path}/profiles/version={version.number}"


def profile(table: Table, version: int | None = None) -> DataFrame:
    """The stored profile of a version. Reads no data."""
    at = version_at(table, version)
    try:
        return table.spark.read.schema(PROFILE_SCHEMA).parquet(_folder(table, at))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise UnknownProfile(f"version {at.number} of {table.path} has no profile") from e


def store_profile(
    table: Table, numbers: Sequence[str] = (), keys: Sequence[str] = (), version: int | None = None
) -> DataFrame:
    """Make and keep the profile of a version; return it. A profile that is there is made anew.

    Where the version before has a profile of the same columns and all of its files, only
    the files added since are read.
    """
    at = version_at(table, version)
    wanted = {(find(at.schema, c).name, "quantiles") for c in numbers} | {(find(at.schema, c).name, "keys") for c in keys}
    files, old = listed(table, at), None
    if at.parent is not None:
        try:
            old = profile(table, at.parent)
        except UnknownProfile:
            old = None
    if old is not None and {(r["column"], r["kind"]) for r in old.select("column", "kind").collect()} == wanted:
        before = listed(table, version_at(table, at.parent)).where("NOT dead").select("name", "holes", F.lit(True).alias("known"))
        marked = files.join(before, ["name", "holes"], "full").withColumn("live", F.coalesce(~F.col("dead"), F.lit(False)))
        if marked.where("known AND NOT live").isEmpty():
            added = paths(table, files.join(before, ["name", "holes"], "left"), F.col("known").isNull())
            fresh = profiled(load(table, at, added), numbers, keys)
            _write(table, at, merged_profiles(old, fresh))
            return profile(table, at.number)
    _write(table, at, profiled(load(table, at, paths(table, files)), numbers, keys))
    return profile(table, at.number)


def _write(table: Table, version: Version, rows: DataFrame) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(_folder(table, version))


def drift(table: Table, old: int, new: int | None = None, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """What two stored profiles say of each column; reads no data.

    Of numbers the quantiles of both, and ``shift``: the largest difference, at one of these
    quantiles, between the shares of rows below. Of keys the estimated numbers of distinct
    values, of those in both, and ``overlap``: the share that are in both of all that are in either.
    """
    a, b = profile(table, old).alias("a"), profile(table, new).alias("b")
    both = a.join(b, (F.col("a.column") == F.col("b.column")) & (F.col("a.kind") == F.col("b.kind")))
    places = F.array(*[F.lit(float(q)) for q in quantiles])
    numbers = F.col("a.kind") == "quantiles"
    known = numbers & (F.kll_sketch_get_n_double("a.sketch") > 0) & (F.kll_sketch_get_n_double("b.sketch") > 0)
    was, now = (F.when(known, F.kll_sketch_get_quantile_double(f"{s}.sketch", places)) for s in "ab")
    # A sketch gives the quantiles of constant shares: on a grid of them, how many are up to a value is its share.
    grid = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])
    steps = [F.when(known, F.kll_sketch_get_quantile_double(f"{s}.sketch", grid)) for s in "ab"]

    def share(values: Column, upto: Column) -> Column:
        return F.size(F.filter(values, lambda v: v <= upto)) / F.lit(GRID)

    shift = F.array_max(F.transform(was, lambda v: F.abs(share(steps[0], v) - share(steps[1], v))))
    n_a, n_b = (F.when(~numbers, F.theta_sketch_estimate(f"{s}.sketch")) for s in "ab")
    n_both = F.when(~numbers, F.theta_sketch_estimate(F.theta_intersection("a.sketch", "b.sketch")))
    n_any = F.when(~numbers, F.theta_sketch_estimate(F.theta_union("a.sketch", "b.sketch", THETA_LOG_SIZE)))
    return both.select(
        "a.column",
        "a.kind",
        F.col("a.rows").alias("rows_old"),
        F.col("b.rows").alias("rows_new"),
        F.col("a.nulls").alias("nulls_old"),
        F.col("b.nulls").alias("nulls_new"),
        was.alias("quantiles_old"),
        now.alias("quantiles_new"),
        shift.alias("shift"),
        n_a.alias("distinct_old"),
        n_b.alias("distinct_new"),
        n_both.alias("distinct_both"),
        F.when(n_any > 0, n_both / n_any).alias("overlap"),
    )


def validate_drift(
    table: Table,
    old: int,
    new: int | None = None,
    *,
    max_shift: Mapping[str, float] | None = None,
    min_overlap: Mapping[str, float] | None = None,
) -> None:
    """Fail where a column moved by more than a share of the rows, or too few of its keys stayed.

    The sketches' own error is on the side of passing: a shift counts when it is beyond the
    limit by more than twice RANK_ERROR and a step of the grid, an overlap by more than three standard errors.
    """
    found = {(r["column"], r["kind"]): r for r in drift(table, old, new).collect()}
    failures = []
    for kind, limits in (("quantiles", max_shift or {}), ("keys", min_overlap or {})):
        for name, limit in limits.items():
            r = found.get((name, kind))
            if r is None:
                raise UnknownProfile(f"the profiles have no {kind} of {name}")
            if kind == "quantiles" and r["shift"] is not None and r["shift"] > limit + 2 * RANK_ERROR + 1 / GRID:
                failures.append(f"{name} moved by {r['shift']:.3f} of the rows, more than {limit}")
            if kind == "keys" and r["overlap"] is not None and r["overlap"] < limit * (1 - 3 * THETA_ERROR):
                failures.append(f"{r['overlap']:.3f} of the values of {name} are in both, fewer than {limit}")
    if failures:
        raise CheckFailed(failures)
