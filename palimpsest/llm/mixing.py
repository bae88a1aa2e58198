"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sizes are words, ``[^\\x20\\x09-\\x0D]+``. All of it is DataFrame code.

Defined cases: a NULL or empty text has size 0 and nothing is taken from it; NULL is a
source of its own, last in order; a source without words has target 0; rows that are
equal share one place in the order, so which of them is cut does not show; an empty
table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def water_filled(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets for sources (null_source, source, source_size): one row per source comes in and goes out.

    Clamping every source above its cap and sharing the excess out again by weight, until
    none is above, ends where every target is min(cap, level * weight) for one level.
    In the order of cap / weight the sources that get clamped come first, so the level
    follows from running sums: it is the largest of what would be left per unit of
    weight if the sources before were clamped.
    """
    order = ["null_source", "source"]
    nth = F.row_number().over(Window.orderBy(*order))
    known = F.array(*[F.lit(w).cast("bigint") for w in weights])
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("fill", *order).rowsBetween(Window.unboundedPreceding, -1)

    def sum_before(c: str) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    rows = (
        sizes.withColumn("weight", F.element_at(known, ((nth - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("fill", F.col("cap").cast("double") / F.col("weight"))
    )
    left = F.sum("source_size").over(everything) - sum_before("cap")
    share = F.sum("weight").over(everything) - sum_before("weight")
    return (
        rows.withColumn("level", left.cast("double") / share)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select(*order, "source_size", "target")
    )


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    whole_documents: bool = False,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The kept columns of each document with size, source_size, target, taken and copies.

    Every document of a source is taken as often as its target allows all of them to be
    taken. What is then left of the target goes to the documents that come first when
    ordered by MD5 of seed and doc_id, one more time each; the last of them gives only
    its first words, so a source's sum is its target rounded. With ``whole_documents``
    it gives all its words or none, whichever is nearer. ``copies`` counts whole copies.

    The order is cut into 4096 parts by the first digits of the MD5, so running sums
    need one row per source and part, and one part of one source in a task at a time.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("NULL"))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"),
        F.col("doc_id").alias("order_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.col("source").isNull().alias("null_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        digest.alias("place"),
    ).withColumn("part", F.substring("place", 1, 3))
    rows = staged(rows, "mix")

    key = ["null_source", "source"]
    parts = rows.groupBy(*key, "part").agg(F.sum("size").alias("words"))
    targets = water_filled(parts.groupBy(*key).agg(F.sum("words").alias("source_size")), weights, max_epochs)
    in_parts = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    in_part = (
        Window.partitionBy(*key, "part").orderBy("place", "order_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    goal = F.col("target").cast("decimal(38,6)").cast("decimal(38,0)").cast("bigint")
    parts = (
        parts.withColumn("before_part", F.coalesce(F.sum("words").over(in_parts), F.lit(0)))
        .join(targets, key)
        .withColumn("goal", goal)
        .withColumn("times", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)))
        .withColumn("more", F.col("goal") - F.col("times") * F.col("source_size"))
        .select(*key, "part", "source_size", "target", "times", (F.col("more") - F.col("before_part")).alias("more"))
    )
    joined = rows.withColumn("before", F.coalesce(F.sum("size").over(in_part), F.lit(0))).join(parts, [*key, "part"])
    left = F.col("more") - F.col("before")
    if whole_documents:
        more = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    else:
        more = F.least("size", F.greatest(F.lit(0), left))
    return (
        joined.withColumn("more", more.cast("bigint"))
        .withColumn("taken", F.col("times") * F.col("size") + F.col("more"))
        .withColumn("copies", F.col("times") + F.when(F.col("more") == F.col("size"), 1).otherwise(0))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)))
        .select("kept.*", "size", "source_size", "target", "taken", "copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it whole; columns as they came.

    Documents go whole here, so that no text is cut.
    """
    columns = docs.columns
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("document"))
    rows = mix(packed, whole_documents=True, keep=("document",), **options)
    return (
        rows.where("copies > 0")
        .select("document", F.explode(F.expr("sequence(1, cast(copies AS int))")).alias("copy"))
        .select("document.*")
    )


SQL = rf"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
           md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'NULL')) AS place
    FROM documents),
s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM d GROUP BY source),
l AS (
    SELECT *, (CAST((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER w, 0) AS DOUBLE)
               / CAST((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS DOUBLE)) AS level
    FROM s WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
    SELECT source, source_size,
           least(CAST(3 * source_size AS DOUBLE), (SELECT max(level) FROM l) * weight) AS target
    FROM l),
g AS (
    SELECT *, CAST(round(target) AS BIGINT) AS goal,
           CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS times
    FROM t),
o AS (
    SELECT doc_id, d.source, size, source_size, target, times, goal,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(times * size + least(size, greatest(0, goal - times * source_size - before)) AS BIGINT) AS taken
FROM o
"""
