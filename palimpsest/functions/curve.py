"""A space-filling order of rows: near in several columns, near in the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.table import col

#: Each column is cut at as many quantiles as give ranks of this many bits.
BITS = 8
#: Rows whose values the quantiles are taken from, at most: those of the smallest hash.
SAMPLE = 8192


def cuts(rows: DataFrame, columns: Sequence[str], bits: int = BITS, sample: int = SAMPLE) -> dict[str, list]:
    """For each column up to 2**bits - 1 values that part the rows about evenly, from a bounded sample.

    NULL is below all values. A value that many rows have is a cut once.
    """
    picked = rows.select([col(c) for c in columns])
    picked = picked.withColumn("at", F.xxhash64(*[col(c) for c in columns], F.monotonically_increasing_id()))
    picked = picked.orderBy("at").limit(sample).drop("at").collect()
    out = {}
    for i, c in enumerate(columns):
        values = sorted((r[i] for r in picked if r[i] is not None), key=_order)
        steps = [values[len(values) * k // (1 << bits)] for k in range(1, 1 << bits)] if values else []
        out[c] = [v for k, v in enumerate(steps) if k == 0 or v != steps[k - 1]]
    return out


def _order(value):
    """As Spark orders: NaN above all numbers, texts by their bytes."""
    if isinstance(value, str):
        return value.encode()
    return (value != value, value)


def rank(value: Column, at: Sequence) -> Column:
    """How many of the ascending cuts are below the value: a tree of comparisons, as deep as the rank has bits."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(at[middle]), below(middle + 1, high)).otherwise(below(low, middle))

    return below(0, len(at))


def interleaved(ranks: Sequence[Column], bits: int = BITS) -> Column:
    """The bits of all ranks, highest first, one rank after the other."""
    out = F.lit(0).cast("bigint")
    for bit in range(bits):
        for i, r in enumerate(ranks):
            to = bit * len(ranks) + len(ranks) - 1 - i
            out = out.bitwiseOR(F.shiftleft(F.shiftright(r.cast("bigint"), bit).bitwiseAND(F.lit(1).cast("bigint")), to))
    return out


def along_curve(rows: DataFrame, columns: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """The rows in ranges of the curve through the ranks of the columns, within each partition value.

    Ranges are cut by Spark from a sample, and rows of one rank are dealt by a hash, so no
    value makes a task that grows with it.
    """
    if not 1 <= len(columns) * BITS <= 63:
        raise ValueError(f"an order goes through 1 to {63 // BITS} columns")
    at = cuts(rows, columns)
    place = interleaved([rank(col(c), at[c]) for c in columns])
    names = [f"palimpsest_{n}" for n in ("place", "salt")]
    rows = rows.withColumn(names[0], place).withColumn(names[1], F.xxhash64(F.monotonically_increasing_id()))
    first = [col(c) for c in partition_by]
    dealt = rows.repartitionByRange(*first, *[F.col(n) for n in names])
    return dealt.sortWithinPartitions(*first, names[0]).drop(*names)
