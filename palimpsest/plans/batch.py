"""The daily batch: raw files in, table made, changed and checked."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import validate
from ..operators.change import delete, update
from ..operators.metadata import files, history
from ..operators.write import create_or_replace
from ..sources.catalog import create_namespace
from ..sources.data import read
from ..sources.log import last_version
from ..sources.raw import read_raw
from ..sources.table import Table


@dataclass(frozen=True)
class Update:
    condition: Column | str
    assignments: Mapping[str, Any]


@dataclass(frozen=True)
class Delete:
    condition: Column | str


@dataclass(frozen=True)
class Checks:
    """What must hold of a table; see ``validate``."""

    min_rows: int | None = None
    expected_rows: int | None = None
    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    schema: T.StructType | str | None = None


@dataclass(frozen=True)
class BatchResult:
    table: Table
    run_date: str
    first_version: int
    last_version: int
    loaded_rows: int
    final_rows: int
    after_load: DataFrame = field(repr=False)
    current: DataFrame = field(repr=False)
    history: DataFrame = field(repr=False)
    files: DataFrame = field(repr=False)

    def show(self) -> None:
        """Print the state of the table, untruncated."""
        for title, df in (
            ("History", self.history),
            (f"Version {self.first_version}", self.after_load),
            (f"Version {self.last_version}", self.current),
            ("Data files", self.files),
        ):
            print(f"{self.table.namespace}.{self.table.name} {self.run_date}: {title}")
            df.show(truncate=False)


STEPS_SCHEMA = "step int, name string, fingerprint string, version int, counted bigint"


class StepLedger:
    """What the steps of one run have done to a table: a row for each, written once the step is done.

    A step's fingerprint covers its own inputs and those of all steps before it. A step is
    taken as done when the ledger has its fingerprint, and the table has not been changed
    since by anything but the steps after it; so a run with other inputs starts where they differ.
    """

    def __init__(self, table: Table, run_date: str) -> None:
        self.table, self.fingerprint, self.step, self.broken = table, run_date, 0, False
        digest = hashlib.sha256(run_date.encode()).hexdigest()[:16]
        self.folder = f"{table.path}/steps/run={digest}"
        try:
            rows = table.spark.read.schema(STEPS_SCHEMA).parquet(self.folder).collect()  # one row a step
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        self.done = {r["fingerprint"]: r for r in sorted(rows, key=lambda r: r["version"])}  # the last time counts
        self.latest = max((r["version"] for r in rows), default=0)

    def run(self, name: str, inputs: Any, version: int | None, work) -> tuple[int, int]:
        """The version and count of a step: of the ledger where it is done, else by doing it."""
        self.step += 1
        self.fingerprint = hashlib.sha256(f"{self.fingerprint}|{name}|{inputs}".encode()).hexdigest()
        known = self.done.get(self.fingerprint)
        if known is not None and not self.broken and self.latest == last_version(self.table):
            return known["version"], known["counted"]
        if not self.broken and version is not None and version != last_version(self.table):
            # Steps after this one were done with other inputs, or someone else changed the table.
            raise OutOfStep(f"{self.table.path} is at version {last_version(self.table)}; step {name} was to follow version {version}")
        self.broken = True
        made, counted = work()
        row = self.table.spark.range(1).select(
            F.lit(self.step).alias("step"),
            F.lit(name).alias("name"),
            F.lit(self.fingerprint).alias("fingerprint"),
            F.lit(made).cast("int").alias("version"),
            F.lit(counted).cast("bigint").alias("counted"),
        )
        row.coalesce(1).write.mode("append").parquet(self.folder)
        return made, counted


class OutOfStep(RuntimeError):
    """A run to be resumed finds the table at another version than its last step left."""


def source_fingerprint(df: DataFrame) -> str:
    """The plan of the rows, and name, size and time of the files they come from. Reads none of them."""
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    names = sorted(df.inputFiles())
    out = hashlib.sha256("|".join(names).encode())
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        status = path.getFileSystem(hadoop).getFileStatus(path)
        out.update(f"{status.getLen()} {status.getModificationTime()}".encode())
    return out.hexdigest() if names else hashlib.sha256(plan.encode()).hexdigest()


def run_steps(
    df: DataFrame,
    table: Table,
    run_date: str,
    *,
    format: str = "parquet",
    partition_by: Sequence[str] = (),
    changes: Sequence[Update | Delete] = (),
    loaded: Checks | None = None,
    final: Checks | None = None,
    resume: bool = False,
) -> BatchResult:
    """Replace the table by these rows, check it, apply the changes in order, check again.

    A check that fails raises, and the steps after it do not run. Running the
    batch again is safe: it replaces the table. With ``resume`` the steps that this run date
    has done, with the same inputs, are not done again: it goes on at the one that failed.
    Where the table is not at the version that step is to follow, it starts over.
    """
    spark = table.spark
    context = spark.sparkContext
    described = context.getLocalProperty("spark.job.description")
    context.setJobDescription(f"{table.namespace}.{table.name} {run_date}")
    try:
        create_namespace(spark, table.namespace, table.root)
        if not resume:
            def step(name: str, inputs: Any, version: int | None, work) -> tuple[int, int]:
                return work()
        else:
            step = StepLedger(table, run_date).run
            try:
                return _steps(df, table, run_date, step, source_fingerprint(df), format, partition_by, changes, loaded, final)
            except OutOfStep:
                again = StepLedger(table, run_date)
                again.broken = True  # no step counts as done
                step = again.run
        return _steps(df, table, run_date, step, source_fingerprint(df) if resume else "", format, partition_by, changes, loaded, final)
    finally:
        context.setJobDescription(described)


def _steps(
    df: DataFrame,
    table: Table,
    run_date: str,
    step,
    source: str,
    format: str,
    partition_by: Sequence[str],
    changes: Sequence[Update | Delete],
    loaded: Checks | None,
    final: Checks | None,
) -> BatchResult:
    def load() -> tuple[int, int]:
        return create_or_replace(df, table, format=format, partition_by=partition_by), 0

    first, _ = step("load", (source, format, tuple(partition_by), df.schema.simpleString()), None, load)
    after_load = read(table, first)
    _, loaded_rows = step("check loaded", loaded, first, lambda: (first, _check(after_load, loaded)))
    last = first
    for i, change in enumerate(changes):

        def work(change: Update | Delete = change) -> tuple[int, int]:
            if isinstance(change, Update):
                return update(table, change.condition, change.assignments), 0
            return delete(table, change.condition), 0

        last, _ = step(f"change {i + 1}", change, last, work)
    current = read(table, last)
    _, final_rows = step("check final", final, last, lambda: (last, _check(current, final)))
    return BatchResult(
        table=table,
        run_date=run_date,
        first_version=first,
        last_version=last,
        loaded_rows=loaded_rows,
        final_rows=final_rows,
        after_load=after_load,
        current=current,
        history=history(table),
        files=files(table, last),
    )


def run_batch(
    spark: SparkSession,
    run_date: str,
    raw_path: str | list[str],
    table: Table,
    schema: T.StructType | str,
    *,
    raw_format: str = "parquet",
    raw_options: Mapping[str, str] | None = None,
    **steps: Any,
) -> BatchResult:
    """Take raw files in and run the steps on them. ``steps`` as in ``run_steps``."""
    raw = read_raw(spark, raw_path, schema, raw_format, **(raw_options or {}))
    return run_steps(raw, table, run_date, **steps)


def _check(df: DataFrame, checks: Checks | None) -> int:
    checks = checks or Checks()
    return validate(
        df,
        min_rows=checks.min_rows,
        expected_rows=checks.expected_rows,
        not_null=checks.not_null,
        unique=checks.unique,
        schema=checks.schema,
    )
