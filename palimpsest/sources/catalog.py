"""Catalogs, namespaces and SQL over the tables of a namespace."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .data import read
from .log import LOG_SCHEMA
from .table import Table


def list_catalogs(spark: SparkSession) -> list[str]:
    return [c.name for c in spark.catalog.listCatalogs()]


def create_namespace(spark: SparkSession, namespace: str, root: str | None = None) -> None:
    """Make the namespace known to Spark; does nothing where it is there.

    With a root, the namespace's folder is the one its tables are in.
    """
    if not re.fullmatch(r"[A-Za-z0-9_]+", namespace):
        raise ValueError(f"not a valid name: {namespace!r}")
    location = ""
    if root is not None:
        path = f"{root.rstrip('/')}/{namespace}".replace("\\", "\\\\").replace("'", "\\'")
        location = f" LOCATION '{path}'"
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}{location}")


def list_tables(spark: SparkSession, root: str, namespace: str) -> list[str]:
    """Names of the tables of a namespace. Lists folders, runs no job."""
    try:
        logs = spark.read.schema(LOG_SCHEMA).parquet(f"{root.rstrip('/')}/{namespace}/*/log/version=*")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted({p.split("/")[-4] for p in logs.inputFiles()})


def register_views(
    spark: SparkSession,
    root: str,
    namespace: str,
    versions: dict[str, int] | None = None,
    names: Sequence[str] | None = None,
    prefix: str = "",
) -> list[str]:
    """A temporary view for every table of a namespace, or the named ones, so that ``spark.sql`` sees them.

    Views of a prefix do not meet those of another namespace: ``prefix="sales_"`` makes
    ``sales_orders`` of ``orders``.

    ``versions`` asks for an older version of some tables. A view shows the
    version it was made for: register again after a change.
    """
    versions = versions or {}
    there = list_tables(spark, root, namespace)
    names = there if names is None else list(names)
    unknown = {*versions, *names} - set(there)
    if unknown:
        raise ValueError(f"no tables {sorted(unknown)} in {namespace}")
    for name in names:
        read(Table(spark, root, namespace, name), versions.get(name)).createOrReplaceTempView(prefix + name)
    return names


def sql(
    spark: SparkSession,
    root: str,
    namespace: str,
    text: str,
    names: Sequence[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """Run a query against the current tables of a namespace, or only the named ones.

    Only tables whose name, after the prefix, is a word of the query are opened.
    """
    words = {w.lower() for w in re.findall(r"\w+", text)}
    if names is None:
        names = [n for n in list_tables(spark, root, namespace) if (prefix + n).lower() in words]
    register_views(spark, root, namespace, names=names, prefix=prefix)
    return spark.sql(text)
