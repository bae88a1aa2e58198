"""Raw files to typed rows, without losing a value on the way."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .table import checked_cast, col


def read_raw(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    format: str = "parquet",
    may_cut: Sequence[str] = (),
    **options: str,
) -> DataFrame:
    """The declared columns of raw files, in the declared types.

    Other columns are not kept. A value that does not fit its type, or would lose a part of
    itself in it (1.7 as an int, a time as a date), fails the job; of the columns in
    ``may_cut`` only what cannot be cast at all does. So
    do a broken JSON line and a CSV row with more or fewer fields than its file has
    columns, unless the option ``mode`` asks Spark for something else. With a header, CSV
    columns are taken by the names in each file's own header, whatever their order.
    JSON is read with the declared schema, so opening it runs no job.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    kind = format.lower()
    if kind == "json":
        return spark.read.format(format).schema(schema).options(**{"mode": "FAILFAST", **options}).load(path)
    if kind == "csv":
        raw = _csv(spark, path, schema, {"mode": "FAILFAST", **options})
    else:
        raw = spark.read.format(format).options(**options).load(path)
    types = {f.name.lower(): f.dataType for f in raw.schema}
    may_cut = {c.lower() for c in may_cut}
    return raw.select(
        [
            checked_cast(
                col(f.name), f.dataType, f.name, None if f.name.lower() in may_cut else types.get(f.name.lower())
            ).alias(f.name)
            for f in schema
        ]
    )


def _csv(spark: SparkSession, path: str | list[str], schema: T.StructType, options: Mapping[str, str]) -> DataFrame:
    """All fields as text. One pass over the files' lines finds their headers; files of one header are read together.

    Columns are not pruned while rows are parsed: only then are missing and surplus fields seen.
    """
    options = {str(k).lower(): v for k, v in options.items()}
    options = {"columnpruning": "false", **options}

    def opened(names: list[str], paths: str | list[str]) -> DataFrame:
        texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return spark.read.format("csv").schema(texts).options(**options).load(paths)

    if str(options.get("header", "false")).lower() != "true":
        return opened(schema.names, path)
    options["enforceschema"] = "false"
    lines = {k: options[k] for k in ("encoding", "linesep", "pathglobfilter", "recursivefilelookup") if k in options}
    first = (
        spark.read.format("text")
        .options(**lines)
        .load(path)
        .where(F.col("value") != "")
        .where(~F.col("value").startswith(options["comment"]) if options.get("comment") else F.lit(True))
        .select(
            "value",
            # The path is encoded; ``url_decode`` would also turn a plus sign into a space.
            F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file"),
            F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        )
        .groupBy("file")
        .agg(F.min_by("value", "place").alias("header"))
    )
    headers = [r["header"] for r in first.select("header").distinct().collect()]
    if not headers:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in schema.names]))
    marks = {"delimiter": options.get("sep", options.get("delimiter", ",")), "quotechar": options.get("quote") or '"'}
    escape = options.get("escape", "\\")
    out = None
    for header in sorted(headers):
        names = next(csv.reader([header], **marks, escapechar=escape if escape != marks["quotechar"] else None))
        names = [n.strip() for n in names]
        where = path
        if len(headers) > 1:
            where = [r["file"] for r in first.where(F.col("header") == header).select("file").collect()]
        rows = opened(names, where).select([col(n) for n in schema.names])
        out = rows if out is None else out.unionByName(rows)
    return out
