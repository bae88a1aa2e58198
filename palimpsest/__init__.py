"""Versioned tables on plain Parquet or ORC files, for Spark."""

from .functions.checks import CheckFailed, count_rows, repeated_keys, validate
from .functions.rows import deleted, insert_row, remove_row, set_columns, updated
from .operators.change import delete, update
from .operators.changes import changes_between
from .operators.columns import add_column, drop_column, rename_column, widen_column
from .operators.compact import compact
from .operators.merge import RepeatedSourceKey, merge
from .operators.merge_where import merge_where
from .operators.metadata import files, history, register_metadata_views, snapshots
from .operators.profile import UnknownProfile, drift, profile, store_profile, validate_drift
from .operators.write import append, create_or_replace
from .plans.batch import BatchResult, Checks, Delete, Update, run_batch, run_steps
from .plans.ingest import ChangedFile, ingest, taken_files
from .plans.statements import UnknownStatement, run_sql
from .sources.catalog import create_namespace, list_catalogs, list_tables, register_views, sql
from .sources.data import read
from .sources.log import ConcurrentWrite, UnknownTable, UnknownVersion
from .sources.raw import read_raw
from .sources.table import Table

__all__ = [
    "BatchResult",
    "ChangedFile",
    "CheckFailed",
    "Checks",
    "ConcurrentWrite",
    "Delete",
    "RepeatedSourceKey",
    "Table",
    "UnknownProfile",
    "UnknownStatement",
    "UnknownTable",
    "UnknownVersion",
    "Update",
    "add_column",
    "append",
    "changes_between",
    "compact",
    "count_rows",
    "create_namespace",
    "create_or_replace",
    "delete",
    "deleted",
    "drift",
    "drop_column",
    "files",
    "history",
    "ingest",
    "insert_row",
    "list_catalogs",
    "list_tables",
    "merge",
    "merge_where",
    "profile",
    "read",
    "read_raw",
    "register_metadata_views",
    "register_views",
    "remove_row",
    "rename_column",
    "repeated_keys",
    "run_batch",
    "run_sql",
    "run_steps",
    "set_columns",
    "snapshots",
    "sql",
    "store_profile",
    "taken_files",
    "update",
    "updated",
    "validate",
    "validate_drift",
    "widen_column",
]
