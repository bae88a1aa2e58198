"""Intermediate results as tables in the folder all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BATCH_BYTES = "8m"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application.

    Only the archive Spark serves to them is made here, on the driver; no data is.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).parent.parent
    archive = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def in_batches(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of this package.

    Rows here are texts, so the bytes of a batch are bounded, for the session, at BATCH_BYTES.
    """
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset.

    All of an application's are in one folder, which can go once its results are written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write rows once and read them back: cuts lineage, and every later job sees the same rows.

    A lost executor costs the tasks that read from it, never the rows written.
    """
    spark = df.sparkSession
    at = shared_folder(spark, what)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
