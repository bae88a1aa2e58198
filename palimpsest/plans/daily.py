"""The daily batch as a program.

    spark-submit --py-files palimpsest.zip palimpsest/plans/daily.py \\
        --run-date 2024-05-01 --raw s3a://datalake/funcionarios/ --raw-format csv \\
        --root s3a://warehouse --table datalake.funcionarios \\
        --schema "id int, nome string, departamento string, salario double" \\
        --update "departamento = 'Engenharia de Dados'" "salario = salario * 1.10" \\
        --delete "departamento = 'Produto'" \\
        --min-rows 1 --not-null id nome --unique id

Conditions and assignments are SQL text. Updates run before deletes. The exit
status is 1 when a check fails. Memory, executors and object-store keys come
from the Spark configuration of the run.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from palimpsest.functions.checks import CheckFailed
from palimpsest.plans.batch import Checks, Delete, Update, run_batch
from palimpsest.sources.table import Table


def _assignment(text: str) -> tuple[str, str]:
    name, equals, value = text.partition("=")
    if not equals or not name.strip() or not value.strip():
        raise SystemExit(f"not an assignment: {text!r}")
    return name.strip().strip("`"), value.strip()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Load a table, change it and check it.")
    p.add_argument("--run-date", required=True)
    p.add_argument("--raw", required=True, nargs="+", help="raw files or folders")
    p.add_argument("--raw-format", default="parquet")
    p.add_argument("--raw-option", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--root", required=True, help="folder of all tables")
    p.add_argument("--table", required=True, metavar="NAMESPACE.NAME")
    p.add_argument("--schema", required=True, help="columns and types, as in CREATE TABLE")
    p.add_argument("--format", default="parquet", choices=["parquet", "orc"])
    p.add_argument("--partition-by", nargs="*", default=[])
    p.add_argument("--update", nargs="+", action="append", default=[], metavar="CONDITION ASSIGNMENT")
    p.add_argument("--delete", action="append", default=[], metavar="CONDITION")
    p.add_argument("--min-rows", type=int)
    p.add_argument("--expected-rows", type=int)
    p.add_argument("--not-null", nargs="*", default=[])
    p.add_argument("--unique", nargs="*", default=[])
    p.add_argument("--show", action="store_true")
    a = p.parse_args(argv)

    changes: list[Update | Delete] = []
    for condition, *assignments in a.update:
        if not assignments:
            p.error(f"nothing to assign where {condition}")
        changes.append(Update(condition, dict(_assignment(t) for t in assignments)))
    changes += [Delete(c) for c in a.delete]

    namespace, _, name = a.table.partition(".")
    spark = SparkSession.builder.appName(f"{a.table} {a.run_date}").getOrCreate()
    keys = {"not_null": a.not_null, "unique": a.unique}
    try:
        result = run_batch(
            spark,
            a.run_date,
            a.raw,
            Table(spark, a.root, namespace, name),
            a.schema,
            raw_format=a.raw_format,
            raw_options=dict(_assignment(t) for t in a.raw_option),
            format=a.format,
            partition_by=a.partition_by,
            changes=changes,
            loaded=Checks(min_rows=a.min_rows, **keys),
            final=Checks(expected_rows=a.expected_rows, **keys),
        )
    except CheckFailed as e:
        print(f"{a.table} {a.run_date}: {e}", file=sys.stderr)
        return 1
    done = f"{result.loaded_rows} rows loaded, {result.final_rows} rows in version {result.last_version}"
    print(f"{a.table} {a.run_date}: {done}")
    if a.show:
        result.show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
