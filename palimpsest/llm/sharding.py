"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A document's virtual slot is a hash of its doc_id and text and never changes. Which shard a slot
belongs to is in a map, kept as a table with one folder per version; rebalancing makes
the next version by editing the one before: slots move until the bytes of all shards
are near equal. A map has as many rows as there are slots (a parameter), whatever the
number of documents, so it is edited on the driver and broadcast.

Defined cases: a NULL text counts as no bytes plus 1 and has no CRC; documents with the
same doc_id go by their texts; rows equal in doc_id and text are dealt to slots by their
places in the table, so that shards are near equal whatever is repeated; a NULL doc_id
hashes like any other; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_folder, staged

SHARDS = 8
SLOTS = 4096
MAP_SCHEMA = "virtual_slot int, shard int"


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every document; a written table."""
    record = ["doc_id", "size", "text_crc32"]
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = staged(rows, "records")
    repeated = rows.groupBy(*record).count().where("count > 1").select(*[F.col(c).alias(f"same_{c}") for c in record])
    same = [F.col(c).eqNullSafe(F.col(f"same_{c}")) for c in record]
    # One of equal rows is as good as another, so they can be told apart by their places.
    salt = F.when(F.col("same_size").isNotNull(), F.col("place")).otherwise(F.lit(0))
    slot = F.pmod(F.xxhash64(*record, salt), F.lit(slots)).cast("int").alias("virtual_slot")
    return staged(rows.join(repeated, same, "left").select(*record, slot), "slots")


def rebalanced(current: Sequence[int], sizes: Sequence[int], shards: int) -> list[int]:
    """The map with slots moved until no move or swap brings the largest and the smallest shard nearer.

    The largest shard gives the smallest one the slot nearest to half their difference;
    where no slot is smaller than the difference, the two swap the pair whose difference
    is nearest to that half. Every step makes the sum of squares smaller, so it ends.
    """
    owner = list(current)
    load = [0] * shards
    members: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += sizes[slot]
        if sizes[slot]:
            members[shard].add(slot)
    for _ in range(4 * len(owner)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        if gap < 2:
            break
        give = min(members[high], key=lambda s: (abs(2 * sizes[s] - gap), s))
        back = None
        if sizes[give] >= gap:
            give, back = _best_swap(sorted(members[high], key=sizes.__getitem__), sorted(members[low], key=sizes.__getitem__), sizes, gap)
            if give is None:
                break
        moved = sizes[give] - (sizes[back] if back is not None else 0)
        load[high] -= moved
        load[low] += moved
        for slot, a, b in ((give, high, low), (back, low, high)):
            if slot is not None:
                members[a].remove(slot)
                members[b].add(slot)
                owner[slot] = b
    return owner


def _best_swap(high: list[int], low: list[int], sizes: Sequence[int], gap: int) -> tuple[int | None, int | None]:
    """The pair whose difference in size is nearest to half the gap and makes it smaller; both lists by size."""
    best, pair, j = gap, (None, None), 0
    for a in high:
        while j + 1 < len(low) and 2 * (sizes[a] - sizes[low[j + 1]]) >= gap:
            j += 1
        for b in low[j : j + 2]:
            off = abs(2 * (sizes[a] - sizes[b]) - gap)
            if off < best:
                best, pair = off, (a, b)
    return pair


def first_map(slots: int, shards: int) -> list[int]:
    return [slot % shards for slot in range(slots)]


def grown_map(current: Sequence[int], sizes: Sequence[int], shards: int) -> list[int]:
    """The map for one shard more: slots move into the new shard only, from the fullest shards."""
    owner, load = list(current), [0] * shards
    for slot, shard in enumerate(owner):
        load[shard] += sizes[slot]
    goal = sum(load) / (shards + 1)
    by_shard: list[list[int]] = [[] for _ in range(shards)]
    for slot in sorted(range(len(owner)), key=lambda s: (sizes[s], s)):
        by_shard[owner[slot]].append(slot)
    heap = [(-n, shard) for shard, n in enumerate(load)]
    heapq.heapify(heap)
    moved = 0
    while heap and moved < goal:
        n, shard = heapq.heappop(heap)
        slot = by_shard[shard].pop() if by_shard[shard] else None
        if slot is None:
            continue
        if moved + sizes[slot] <= goal:
            owner[slot] = shards
            moved += sizes[slot]
            n += sizes[slot]
        heapq.heappush(heap, (n, shard))
    return owner


def store_map(spark: SparkSession, root: str, version: int, owner: Sequence[int]) -> None:
    rows = spark.createDataFrame(list(enumerate(owner)), MAP_SCHEMA)
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{root}/version={version}")


def load_map(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{root}/version={version}")


def newest_map(spark: SparkSession, root: str) -> int:
    """The number of the newest version of the map, 0 where there is none. Lists the folder, runs no job."""
    try:
        files = spark.read.schema(MAP_SCHEMA).parquet(f"{root}/version=*").inputFiles()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return max((int(f.rsplit("/version=", 1)[1].split("/")[0]) for f in files), default=0)


def edited_map(current: Sequence[int], sizes: Sequence[int], shards: int) -> list[int]:
    """The map for this many shards: new ones are filled from the others, those that go give their slots to the rest, and all are rebalanced."""
    owner, n = [s % shards for s in current], max(current, default=0) + 1
    for more in range(n, shards):
        owner = grown_map(owner, sizes, more)
    return rebalanced(owner, sizes, shards)


def assign(docs: DataFrame, *, shards: int = SHARDS, slots: int = SLOTS, root: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot and map_version of every document.

    ``slot`` counts the rows of a shard from 0 without gaps: the rows of the slots
    before, plus the place in the slot. The law is `bytes`: sizes near equal. Where ``root``
    holds a map, its newest version is edited and the next one stored; else the first is made.
    """
    spark = docs.sparkSession
    root = root or shared_folder(spark, "shard-map")
    rows = slotted(docs, slots)
    loads = rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    sizes, counts = [0] * slots, [0] * slots
    for r in loads:  # at most one row per slot
        sizes[r["virtual_slot"]], counts[r["virtual_slot"]] = r["size"], r["rows"]
    version = newest_map(spark, root)
    if version == 0:
        version = 1
        store_map(spark, root, version, first_map(slots, shards))
    current = [r["shard"] for r in load_map(spark, root, version).orderBy("virtual_slot").collect()]
    if len(current) != slots:
        raise ValueError(f"the map at {root} has {len(current)} slots, not {slots}; their number is fixed")
    version += 1
    store_map(spark, root, version, edited_map(current, sizes, shards))
    owner = {r["virtual_slot"]: r["shard"] for r in load_map(spark, root, version).collect()}

    places, filled = [], [0] * shards
    for slot in range(slots):
        places.append((slot, owner[slot], filled[owner[slot]]))
        filled[owner[slot]] += counts[slot]
    where = spark.createDataFrame(places, "virtual_slot int, shard int, first_row bigint")
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(in_slot))
        .join(F.broadcast(where), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first_row") + F.col("nth") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.lit(version).alias("map_version"),
        )
    )
