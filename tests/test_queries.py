"""Every query against DuckDB on the same tables."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

import duckdb  # noqa: E402  without it these tests fail, they do not vanish

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

from .conftest import SF  # noqa: E402


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


# Queries of the llm subpackage, where it is there, have tests of their own.
OWN = [name for name in queries() if not re.match(r"op\d+_|pipeline$", name)]


def test_every_query_has_its_sql():
    assert set(OWN) <= set(oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, oracle, name):
    df = queries()[name](spark, SF)
    want = oracle.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = by_name(df.columns, [tuple(r) for r in df.collect()])
    expected = by_name(columns, want.fetchall())
    assert len(got) > 0
    assert got == expected


def test_entry(spark):
    df = entry(spark)
    assert len(df.columns) == 6
    assert df.count() > 0
