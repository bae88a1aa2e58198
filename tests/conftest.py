import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from palimpsest import Table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("palimpsest-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def table(spark, root):
    return Table(spark, root, "datalake", "t")


@pytest.fixture
def orders(spark):
    return spark.read.parquet(str(Path(SF) / "orders.parquet"))


def rows(df):
    """Rows as a sorted list of tuples, for comparing tables."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
