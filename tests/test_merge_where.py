"""MERGE on conditions other than equal keys, against plain Python."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest import RepeatedSourceKey, create_or_replace, insert_row, merge_where, read, remove_row, set_columns
from palimpsest.operators.merge_where import compared, in_bins

from .conftest import rows

T_SCHEMA, S_SCHEMA = "id bigint, x double, p string", "low double, high double, name string"


def merged(target, source, hit):
    """Rows after WHEN MATCHED set p, WHEN NOT MATCHED insert name, WHEN NOT MATCHED BY SOURCE AND id % 5 = 0 delete."""
    out, used = [], set()
    for t in target:
        found = [i for i, s in enumerate(source) if hit(t, s)]
        used |= set(found)
        if found:
            out.append((t[0], t[1], source[found[0]][2]))
        elif t[0] % 5:
            out.append(t)
    return sorted(out + [(None, None, s[2]) for i, s in enumerate(source) if i not in used], key=repr)


CLAUSES = {
    "matched": [set_columns({"p": "s.name"})],
    "not_matched": [insert_row({"p": "s.name"})],
    "not_matched_by_source": [remove_row("t.id % 5 = 0")],
}


def ge(a, b):
    return a is not None and b is not None and (math.isnan(a) or (not math.isnan(b) and a >= b))


@pytest.mark.parametrize("format", ["parquet", "orc"])
def test_ranges_against_brute_force(spark, table, format):
    rng = random.Random(3)
    target = [(i, rng.choice([None, math.nan, math.inf, -1e300, round(rng.uniform(-50, 1050), 1)]), "p") for i in range(300)]
    edges = sorted(rng.sample(range(0, 1000), 40))
    source = [(float(a), a + rng.choice([0.0, 0.4, (b - a) / 2, b - a - 0.1]), f"n{a}") for a, b in zip(edges, edges[1:], strict=False)]
    source += [(None, 5.0, "null"), (9.0, 3.0, "empty"), (1e6, math.inf, "far"), (-math.inf, -100.0, "low")]
    create_or_replace(spark.createDataFrame(target, T_SCHEMA).repartition(4), table, format=format)
    merge_where(table, spark.createDataFrame(source, S_SCHEMA), "t.x BETWEEN s.low AND s.high", **CLAUSES)
    # As text, in which NaN equals NaN.
    assert repr(rows(read(table))) == repr(merged(target, source, lambda t, s: ge(t[1], s[0]) and ge(s[1], t[1])))


@pytest.mark.parametrize(
    "condition, hit",
    [
        ("t.x > s.low AND t.x < s.high", lambda t, s: s[0] < t[1] < s[1]),
        ("s.high >= t.x AND t.x > s.low AND t.p = s.name", lambda t, s: s[0] < t[1] <= s[1] and t[2] == s[2]),
        ("t.x >= s.low AND t.p <=> s.name", lambda t, s: t[1] >= s[0] and t[2] == s[2]),
        ("t.x + 1 BETWEEN s.low AND s.high AND t.id % 2 = length(s.name)", lambda t, s: s[0] <= t[1] + 1 <= s[1] and t[0] % 2 == len(s[2])),
        ("upper(t.p) = upper(s.name)", lambda t, s: t[2] == s[2]),
        ("s.low BETWEEN t.x - 3 AND t.x", lambda t, s: t[1] - 3 <= s[0] <= t[1]),
    ],
)
def test_conditions(spark, table, condition, hit):
    target = [(i, float(i), "abc"[i % 3]) for i in range(60)]
    source = [(10.0, 14.0, "a"), (20.0, 20.5, "b"), (50.0, 59.0, "c"), (100.0, 200.0, "z")]
    create_or_replace(spark.createDataFrame(target, T_SCHEMA), table, partition_by=["p"])
    merge_where(table, spark.createDataFrame(source, S_SCHEMA), condition, **CLAUSES)
    assert rows(read(table)) == merged(target, source, hit)


def test_dates_and_times(spark, table):
    day = datetime.date(2024, 1, 1)
    data = [(i, day + datetime.timedelta(days=i), datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)) for i in range(50)]
    create_or_replace(spark.createDataFrame(data, "id bigint, d date, m timestamp_ntz"), table)
    spans = [(day, day + datetime.timedelta(days=9), 1), (day + datetime.timedelta(days=20), day + datetime.timedelta(days=21), 2)]
    source = spark.createDataFrame(spans, "start date, end date, n bigint")
    merge_where(table, source, "t.d BETWEEN s.start AND s.end", matched=[set_columns({"id": "-s.n"})])
    assert sorted(r["id"] for r in read(table).collect()) == sorted([-1] * 10 + [-2] * 2 + [i for i in range(50) if not (i < 10 or 20 <= i <= 21)])
    merge_where(table, source, "t.m >= s.start AND t.m < s.end", matched=[remove_row()])
    assert read(table).count() == 0  # all 50 hours are in the first span


def test_a_row_that_matches_twice(spark, table):
    create_or_replace(spark.createDataFrame([(1, 5.0, "p"), (2, 50.0, "q")], T_SCHEMA), table)
    source = spark.createDataFrame([(0.0, 10.0, "a"), (4.0, 6.0, "b"), (60.0, 70.0, "c"), (60.0, 70.0, "c")], S_SCHEMA)
    between = "t.x BETWEEN s.low AND s.high"
    with pytest.raises(RepeatedSourceKey, match="2 source rows"):
        merge_where(table, source, between, matched=[set_columns({"p": "s.name"})])
    assert len(rows(read(table))) == 2
    merge_where(table, source, between, not_matched=[insert_row({"p": "s.name"})])
    assert read(table).count() == 4
    merge_where(table, source, between, matched=[remove_row()])  # gone whichever is meant
    assert rows(read(table).where("id IS NOT NULL")) == [(2, 50.0, "q")]


def test_empty_sides(spark, table):
    create_or_replace(spark.createDataFrame([(1, 5.0, "p")], T_SCHEMA), table)
    none = spark.createDataFrame([], S_SCHEMA)
    merge_where(table, none, "t.x BETWEEN s.low AND s.high", **CLAUSES)
    assert rows(read(table)) == [(1, 5.0, "p")]
    merge_where(table, none, "t.x > s.low", not_matched_by_source=[remove_row()])
    assert rows(read(table)) == []
    merge_where(table, spark.createDataFrame([(1.0, 2.0, "a")], S_SCHEMA), "t.x > s.low", **CLAUSES)
    assert rows(read(table)) == [(None, None, "a")]


def test_refused(spark, table):
    create_or_replace(spark.createDataFrame([(1, 5.0, "p")], T_SCHEMA), table)
    source = spark.createDataFrame([(1.0, 2.0, "a")], S_SCHEMA)
    for condition, why in (("t.x <> s.low", "equality or a range"), ("t.p < s.name", "equality or a range"), ("t.x > s.low AND rand() < 0.5", "same answer")):
        with pytest.raises(ValueError, match=why):
            merge_where(table, source, condition, **CLAUSES)
    with pytest.raises(ValueError, match="clause"):
        merge_where(table, source, "t.x > s.low")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loops_and_hot_bins_are_split(spark):
    """A third of all rows in one interval: the join on its bin is cut."""
    hot = F.when(F.col("id") % 3 == 0, F.lit(5.5)).otherwise(F.col("id") * 1.0)
    target = spark.range(0, 300_000, 1, 8).select("id", hot.alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("p"))
    source = spark.range(3000).select((F.col("id") * 100.0).alias("low"), (F.col("id") * 100 + 99.5).alias("high"), F.col("id").cast("string").alias("name"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        t, s, same = in_bins(target, source, compared(target, source, F.expr("t.x BETWEEN s.low AND s.high")))
        joined = t.join(s, same & F.expr("t.x BETWEEN s.low AND s.high")).select("t.id", "t.p", "s.name")
        assert len(joined.collect()) == 300_000
        text = plan(joined)
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin(skew=true)" in text
    bins = s.groupBy("name").count().agg(F.max("count")).first()[0]
    assert bins <= 3
