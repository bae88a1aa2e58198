"""Sketches of versions."""

import math

import pytest
from pyspark.sql import functions as F

from palimpsest import CheckFailed, UnknownProfile, append, create_or_replace, delete, drift, profile, store_profile, validate_drift
from palimpsest.operators.profile import KLL_SIZE, RANK_ERROR


def numbers(spark, low, high):
    return spark.range(low, high, 1, 4).select(F.col("id").alias("k"), (F.col("id") % 1000 / 10).alias("x"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("d"))


def found(table, old, new, column):
    return drift(table, old, new).where(F.col("column") == column).first()


def test_drift_of_versions(spark, table):
    create_or_replace(numbers(spark, 0, 50_000), table)
    store_profile(table, ["x", "d"], ["k"])
    append(numbers(spark, 50_000, 60_000).withColumn("x", F.lit(500.0)), table)
    store_profile(table, ["x", "d"], ["k"])
    x, k = found(table, 1, 2, "x"), found(table, 1, 2, "k")
    assert (x["rows_old"], x["rows_new"], x["nulls_new"]) == (50_000, 60_000, 0)
    assert abs(x["quantiles_old"][3] - 50) < 100 * 2 * RANK_ERROR and x["quantiles_new"][-1] == 500.0
    assert abs(x["shift"] - 0.99 / 6) < 4 * RANK_ERROR  # of the upper rows a sixth is somewhere else
    assert abs(k["distinct_new"] / 60_000 - 1) < 0.04 and abs(k["overlap"] - 5 / 6) < 0.04
    validate_drift(table, 1, 2, max_shift={"x": 0.2, "d": 0.01}, min_overlap={"k": 0.8})
    with pytest.raises(CheckFailed) as e:
        validate_drift(table, 1, 2, max_shift={"x": 0.1}, min_overlap={"k": 0.95})
    assert len(e.value.failures) == 2


def test_an_append_reads_its_own_files_only(spark, table, monkeypatch):
    create_or_replace(numbers(spark, 0, 1000), table)
    store_profile(table, ["x"], ["k"])
    append(numbers(spark, 1000, 1500), table)
    opened = []
    import palimpsest.operators.profile as module

    whole = module.load
    monkeypatch.setattr(module, "load", lambda t, v, p: opened.append(whole(t, v, p)) or opened[-1])
    store_profile(table, ["x"], ["k"])
    assert opened[-1].count() == 500
    assert {(r["rows"], r["nulls"]) for r in profile(table).collect()} == {(1500, 0)}
    assert found(table, 1, 2, "k")["distinct_new"] == 1500  # few enough to be exact
    delete(table, "k < 100")
    store_profile(table, ["x"], ["k"])  # sketches cannot lose rows
    assert opened[-1].count() == 1400 and found(table, 2, 3, "k")["distinct_both"] == 1400


def test_defined_cases(spark, table):
    df = spark.createDataFrame([(None, None), (math.nan, "a"), (1.0, "a"), (2.0, None)], "x double, s string")
    create_or_replace(df, table)
    with pytest.raises(UnknownProfile):
        profile(table)
    store_profile(table, ["x"], ["s", "x"])
    assert {(r["column"], r["kind"], r["rows"], r["nulls"]) for r in profile(table).collect()} == {("x", "quantiles", 4, 1), ("x", "keys", 4, 1), ("s", "keys", 4, 2)}
    create_or_replace(df.limit(0), table)
    store_profile(table, ["x"], ["s", "x"])
    r = drift(table, 1, 2).where("kind = 'quantiles'").first()
    assert (r["rows_old"], r["rows_new"], r["shift"]) == (4, 0, None)
    assert found(table, 1, 2, "s")["distinct_new"] == 0
    with pytest.raises(ValueError, match="no quantiles"):
        store_profile(table, ["s"])
    with pytest.raises(UnknownProfile, match="quantiles of s"):
        validate_drift(table, 1, 2, max_shift={"s": 0.1})
    assert KLL_SIZE == 800
