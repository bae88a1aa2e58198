"""Prefix trie of conversations as a z-fast trie, built in batches of DataFrame joins.

A conversation is the sequence of its rebuilt turns. A prefix is known by its hash (two
times 64 bits: each turn's digest is hashed with its place, and the hashes are added by
XOR), which a table holds for every place of every distinct conversation. Compacted nodes
are the ends of conversations and the places where two part; a node stands for an edge, the
depths ``low < d <= high`` of its representative. The dictionary has every node under the
hash at its handle, the depth in (low, high] that is divisible by the largest power of two
(two-fattest).

1. Turns are ranked in order and rebuilt. Conversations of equal turns are one from here on,
   with the number of its copies.
2. Conversations are inserted in batches. Each finds its exit node by its lowest prefix that
   is a handle. A fat binary search would look up one prefix after the other, each by two more
   joins in a plan; here one join looks up all of them. The node found is the exit node or
   its parent, as the handles of all nodes above are met. Where the conversation leaves the edge is the last depth at which its hashes
   and the edge's agree. Of those that leave at the same place by the same turn, one, drawn
   by hash, goes in now and the others with the next batch; edges are cut at all places of
   a batch at once. The number of batches grows with the logarithm of the conversations.
3. Members, leaves and sums of a node's subtree come by pointer doubling: in each step a
   node hands what it has to the ancestor as many nodes up as in all steps before.
4. Edges are expanded to a row for each depth. Digests of member lists run over sorted
   pieces of a bounded number of members.

Nothing of the trie is on the driver. A conversation that holds a third of all turns is
spread by ranges of its turns and blocks of its prefixes, a turn or a prefix that many
share is one row for each distinct conversation, and copies are counted before they move.
All is DataFrame code but the digests.

Defined cases: rows without conv_id are no conversation; turns with the same number go by
the hash of role and text, and a row that is repeated is as many turns; the NULL turn is the
first; NULL role or text is empty, so such turns equal turns with empty ones; a conversation
may be left without turns and is then a member of the root only; where no conversation has turns
the root is the only node and a leaf; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import in_batches, staged

#: Every conversation c starts as conversation c - c % FAMILY does.
FAMILY = 100
#: It takes fewer than this many turns from there.
SHARED = 6
#: Places of a conversation whose hashes are added up in one piece, and depths of an edge expanded at once.
BLOCK = 4096
#: Members whose numbers make one piece of text have numbers in one range of this size.
MEMBERS = 1 << 16

#: Rows, some 100 bytes each, of a table that joins may send to all tasks; larger ones are shuffled.
BROADCAST_ROWS = 1 << 18

NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, rank from 1, digest and number of code points of every turn; a written table.

    Turns are sorted by range, so one conversation may lie in many tasks; the ranks of each
    piece go on from those before.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_hash"),
        F.length(text).cast("bigint").alias("size"),
        F.monotonically_increasing_id().alias("nth"),  # tells repeated rows apart, so that they can be dealt out
    )
    rows = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "turn_hash", "nth")
    rows = staged(rows.withColumn("part", F.spark_partition_id()).drop("nth"), "turns")
    order = Window.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_hash")
    here = rows.withColumn("rank", F.row_number().over(order).cast("bigint"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("earlier", F.sum("n").over(before))
    # At most one conversation goes on from one part to the next.
    earlier = earlier.where("earlier > 0").select("conv_id", "part", "earlier")
    rank = F.col("rank") + F.coalesce("earlier", F.lit(0))
    return staged(
        here.join(F.broadcast(earlier), ["conv_id", "part"], "left").select("conv_id", rank.alias("rank"), "turn_hash", "size"),
        "ranked",
    )


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv_id, length), and their turns (conv_id, pos from 1, x1, x2, size); written tables."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("conv_id")
    own = lengths.select(
        c, "n", (c - c % family).alias("base"), (F.crc32(c.cast("string")) % shared).alias("h")
    )
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")
    convs = own.join(base, "base", "left").select("conv_id", "base", "h", "n", taken)
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = staged(convs.select("conv_id", "base", "h", "taken", length.alias("length")), "rebuilt")
    mine = turns.join(convs, "conv_id").where("rank > h")
    mine = mine.select("conv_id", (F.col("rank") - F.col("h") + F.col("taken")).alias("pos"), "turn_hash", "size")
    first = turns.where((c % family == 0) & (F.col("rank") < shared))
    first = first.select(c.alias("base"), F.col("rank").alias("pos"), "turn_hash", "size")
    theirs = first.join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("pos <= taken")
    rows = mine.unionByName(theirs.select("conv_id", "pos", "turn_hash", "size"))
    x1, x2 = F.xxhash64("pos", "turn_hash"), F.xxhash64("turn_hash", "pos")
    rows = staged(rows.select("conv_id", "pos", x1.alias("x1"), x2.alias("x2"), "size"), "rebuilt-turns")
    return convs.select("conv_id", "length"), rows


def prefixes_of(rows: DataFrame) -> DataFrame:
    """(rep, pos, h1, h2, total): hash of each prefix and code points up to its end; a written table.

    Running sums go by blocks of places, and the blocks before are added.
    """
    rows = rows.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    sums = {"h1": F.bit_xor("x1"), "h2": F.bit_xor("x2"), "total": F.sum("size")}
    along = Window.partitionBy("rep", "block").orderBy("pos")
    here = rows.select("rep", "block", "pos", *[s.over(along).alias(k) for k, s in sums.items()])
    blocks = rows.groupBy("rep", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("size").alias("size"))
    before = Window.partitionBy("rep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("rep", "block", *[s.over(before).alias(f"{k}_before") for k, s in sums.items()]).where("block > 0")
    h1, h2 = (F.col(k).bitwiseXOR(F.coalesce(f"{k}_before", F.lit(0).cast("bigint"))).alias(k) for k in ("h1", "h2"))
    total = F.col("total") + F.coalesce("total_before", F.lit(0))
    return staged(here.join(blocks, ["rep", "block"], "left").select("rep", "pos", h1, h2, total.alias("total")), "prefixes")


def _side(table: DataFrame) -> DataFrame:
    """A written table to look up in: its size decides how joins meet it, not what they find."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def fattest(low: str, high: str) -> Column:
    """The number in (low, high] that is divisible by the largest power of two."""
    return F.expr(f"{high} & shiftleft(-1L, length(bin({low} ^ {high})) - 1)")


def hash_at(rows: DataFrame, prefixes: DataFrame, rep: str, pos: Column, names: tuple[str, str]) -> DataFrame:
    """With the hash of the representative's prefix of a length; NULL where it has none."""
    there = prefixes.select(
        F.col("rep").alias("rep_of"), F.col("pos").alias("pos_of"), *[F.col(h).alias(n) for h, n in zip(("h1", "h2"), names, strict=True)]
    )
    return rows.withColumn("asked", pos).join(
        there, (F.col(rep) == F.col("rep_of")) & (F.col("asked") == F.col("pos_of")), "left"
    ).drop("asked", "rep_of", "pos_of")


NODE = ["node_rep", "low", "high", "id1", "id2", "up1", "up2"]


def _keyed(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Nodes with the hashes at their handle and at their first depth."""
    nodes = hash_at(nodes, prefixes, "node_rep", fattest("low", "high"), ("key1", "key2"))
    return hash_at(nodes, prefixes, "node_rep", F.col("low") + 1, ("first1", "first2"))


def _hit(nodes: DataFrame, by: str) -> DataFrame:
    """Nodes under other names, to look up by one of their hashes."""
    return nodes.select(F.col(f"{by}1").alias("by1"), F.col(f"{by}2").alias("by2"), *[F.col(c).alias(f"z_{c}") for c in NODE])


def _take(rows: DataFrame, where: Column, *drop: str) -> DataFrame:
    """The node looked up takes the place of the one held, where that is so."""
    return rows.withColumns({c: F.when(where, F.col(f"z_{c}")).otherwise(F.col(c)) for c in NODE}).drop(
        "by1", "by2", *[f"z_{c}" for c in NODE], *drop
    )


def locate(pending: DataFrame, nodes: DataFrame, every: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(rep, length, h1, h2), the depth ``at`` at which each leaves the trie, and the node whose edge it leaves.

    ``at`` of ``pending`` is a depth at which a node ends that the conversation goes on from.
    ``prefixes`` are to look up in, ``every`` are the same, to look up.
    """
    rows = pending.withColumn("sure", F.col("at"))
    on = (F.col("g1") == F.col("by1")) & (F.col("g2") == F.col("by2"))
    # Every prefix below ``at`` is looked up at once; of the handles met the lowest stays.
    asked = every.join(pending.select("rep", "at"), "rep").where("pos > at")
    asked = asked.select("rep", "pos", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    met = asked.join(_hit(nodes, "key"), on).groupBy("rep")
    met = met.agg(F.max(F.struct("pos", *[F.col(f"z_{c}").alias(c) for c in NODE])).alias("met"))
    rows = rows.join(met, "rep", "left").withColumns({c: F.col(f"met.{c}") for c in NODE})
    rows = rows.withColumn("sure", F.coalesce("met.pos", "sure")).drop("met")
    # All of the last node found, or only a part? Below its end the exit node is its child.
    end = F.coalesce("high", F.col("at"))
    rows = hash_at(rows, prefixes, "rep", end, ("g1", "g2"))
    whole = F.col("high").isNull() | F.coalesce((F.col("g1") == F.col("id1")) & (F.col("g2") == F.col("id2")), F.lit(False))
    rows = rows.withColumns({"whole": whole, "sure": F.when(whole, end).otherwise(F.col("sure"))}).drop("g1", "g2")
    rows = hash_at(rows, prefixes, "rep", F.when(F.col("whole"), F.col("sure") + 1).otherwise(F.lit(-1)), ("g1", "g2"))
    rows = rows.withColumns({"g1": F.coalesce("g1", F.xxhash64("rep")), "g2": F.coalesce("g2", F.lit(-1))})
    rows = rows.join(_hit(nodes, "first"), on, "left").withColumn("found", F.col("z_high").isNotNull())
    rows = rows.withColumn("sure", F.when(F.col("found"), F.col("z_low") + 1).otherwise(F.col("sure")))
    rows = _take(rows, F.col("found"), "found", "g1", "g2", "whole", "at")
    rows = staged(rows, "exits")
    # How far the conversation and the edge agree.
    open_ = rows.where("sure < least(high, length)").select("rep", "node_rep", "sure", F.least("high", "length").alias("most"))
    mine = every.join(open_, "rep").where("pos > sure AND pos <= most").select("rep", "node_rep", "pos", "h1", "h2")
    edge = prefixes.select(F.col("rep").alias("node_rep"), "pos", "h1", "h2")
    agree = mine.join(edge, ["node_rep", "pos", "h1", "h2"]).groupBy("rep").agg(F.max("pos").alias("agreed"))
    return rows.join(agree, "rep", "left").withColumn("at", F.coalesce("agreed", "sure")).drop("agreed", "sure")


def insert(nodes: DataFrame | None, located: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes after a batch, and the conversations left for the next."""
    located = hash_at(located, prefixes, "rep", F.col("at"), ("p1", "p2"))
    located = located.withColumns({p: F.coalesce(p, F.lit(0).cast("bigint")) for p in ("p1", "p2")})
    located = staged(hash_at(located, prefixes, "rep", F.col("at") + 1, ("next1", "next2")), "located")
    going = located.where("at < length")
    drawn = going.groupBy("next1", "next2").agg(F.min(F.struct(F.xxhash64("h1", "h2"), "rep"))["rep"].alias("rep"))
    leaves = going.join(drawn.select("rep"), "rep", "left_semi")
    left = going.join(drawn.select("rep"), "rep", "left_anti").select("rep", "length", "h1", "h2", "at")
    new = leaves.select(
        F.col("rep").alias("node_rep"),
        F.col("at").alias("low"),
        F.col("length").alias("high"),
        F.col("h1").alias("id1"),
        F.col("h2").alias("id2"),
        F.col("p1").alias("up1"),
        F.col("p2").alias("up2"),
    )
    if nodes is None:
        return staged(_keyed(new, prefixes), "nodes"), staged(left, "pending")
    edge = [F.col(c) for c in NODE]
    cuts = located.where("at < high").groupBy(*edge, F.col("at"), F.col("p1"), F.col("p2")).count().drop("count")
    cuts = staged(cuts, "cuts")
    cut = cuts.select("id1", "id2").distinct()
    pieces = cuts.unionByName(cuts.select(*edge).distinct().select(*edge, F.col("high").alias("at"), F.col("id1").alias("p1"), F.col("id2").alias("p2")))
    order = Window.partitionBy("id1", "id2").orderBy("at")
    pieces = pieces.select(
        "node_rep",
        F.coalesce(F.lag("at").over(order), F.col("low")).alias("low"),
        F.col("at").alias("high"),
        F.col("p1").alias("id1"),
        F.col("p2").alias("id2"),
        F.coalesce(F.lag("p1").over(order), F.col("up1")).alias("up1"),
        F.coalesce(F.lag("p2").over(order), F.col("up2")).alias("up2"),
    )
    kept = nodes.join(cut, ["id1", "id2"], "left_anti").select(nodes.columns)
    return staged(kept.unionByName(_keyed(new.unionByName(pieces), prefixes)), "nodes"), staged(left, "pending")


def build(distinct: DataFrame, every: DataFrame, prefixes: DataFrame) -> DataFrame | None:
    """All compacted nodes but the root, for distinct conversations (rep, length, h1, h2); None where no conversation has turns."""
    pending = distinct.where("length > 0").select("rep", "length", "h1", "h2", F.lit(0).cast("bigint").alias("at"))
    nodes = None
    while not pending.isEmpty():
        located = pending if nodes is None else locate(pending, _side(nodes), every, prefixes)
        nodes, pending = insert(nodes, located, prefixes)
    return nodes


def subtrees(nodes: DataFrame, distinct: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Nodes with their children, and of their subtrees the members, the smallest one, the leaves, and the sums for what is saved.

    ``x`` adds up, over the members, the code points of their conversations; ``y`` those of all edges.
    """
    sizes = prefixes.select(F.col("rep").alias("rep_of"), F.col("pos").alias("pos_of"), "total")
    rows = nodes.select(NODE)
    for at in ("low", "high"):
        rows = rows.join(sizes, (F.col("node_rep") == F.col("rep_of")) & (F.col(at) == F.col("pos_of")), "left")
        rows = rows.withColumn(f"{at}_total", F.coalesce("total", F.lit(0))).drop("rep_of", "pos_of", "total")
    ends = distinct.select(F.col("h1").alias("id1"), F.col("h2").alias("id2"), F.col("rep").alias("m"), F.col("copies").alias("n"))
    below = nodes.groupBy(F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.count(F.lit(1)).alias("n_children"))
    rows = rows.join(ends, ["id1", "id2"], "left").join(below, ["id1", "id2"], "left")
    top = (F.col("up1") == 0) & (F.col("up2") == 0) & (F.col("low") == 0)
    rows = rows.select(
        *NODE,
        "low_total",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "m",
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"),
        (F.coalesce("n", F.lit(0)) * F.col("high_total")).alias("x"),
        (F.col("high_total") - F.col("low_total")).alias("y"),
        F.when(~top, F.col("up1")).alias("to1"),
        F.when(~top, F.col("up2")).alias("to2"),
    )
    rows = staged(rows, "subtrees")
    sums = ("n", "leaves", "x", "y")
    while not rows.where("to1 IS NOT NULL").isEmpty():
        handed = rows.where("to1 IS NOT NULL").groupBy(F.col("to1").alias("id1"), F.col("to2").alias("id2"))
        handed = handed.agg(F.min("m").alias("m_more"), *[F.sum(c).alias(f"{c}_more") for c in sums])
        hops = rows.select(F.col("id1").alias("to1"), F.col("id2").alias("to2"), F.col("to1").alias("on1"), F.col("to2").alias("on2"))
        # Tops are many and go no further.
        going = rows.where("to1 IS NOT NULL").join(hops, ["to1", "to2"])
        done = rows.where("to1 IS NULL").withColumns({c: F.lit(None).cast("bigint") for c in ("on1", "on2")})
        rows = going.unionByName(done).join(handed, ["id1", "id2"], "left").select(
            *NODE,
            "low_total",
            "n_children",
            F.least("m", "m_more").alias("m"),
            *[(F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in sums],
            F.col("on1").alias("to1"),
            F.col("on2").alias("to2"),
        )
        rows = staged(rows, "subtrees")
    return rows.drop("to1", "to2")


def end_digests(members: DataFrame) -> DataFrame:
    """(id1, id2, ends_sha256): digest of the numbers of all conversations that end at a node.

    Numbers of one range make one piece; the pieces of a node run through the digest one after the other.
    """
    pieces = members.groupBy(F.col("h1").alias("id1"), F.col("h2").alias("id2"), F.floor(F.col("conv_id") / MEMBERS).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("numbers")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def closed(out: list) -> list:
            return [*out, (*key, state.hexdigest())] if key is not None else out

        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("id1", "id2", "numbers")), strict=True)
            for id1, id2, numbers in rows:
                if (id1, id2) != key:
                    out = closed(out)
                    key, state = (id1, id2), hashlib.sha256(numbers.encode())
                else:
                    state.update(b"," + numbers.encode())
            yield _digest_rows(out)
        yield _digest_rows(closed([]))

    rows = pieces.repartition("id1", "id2").sortWithinPartitions("id1", "id2", "piece").select("id1", "id2", "numbers")
    return in_batches(rows, digest, "id1 bigint, id2 bigint, ends_sha256 string")


def _digest_rows(rows: list) -> pa.RecordBatch:
    id1, id2, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch(
        {"id1": pa.array(id1, pa.int64()), "id2": pa.array(id2, pa.int64()), "ends_sha256": pa.array(digest, pa.string())}
    )


def expanded(tree: DataFrame, root_m: int, prefixes: DataFrame) -> DataFrame:
    """A row for every depth of every edge."""
    parents = tree.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("m").alias("up_m"))
    rows = tree.where("low > 0").join(parents, ["up1", "up2"]).unionByName(
        tree.where("low = 0").withColumn("up_m", F.lit(root_m).cast("bigint"))
    )
    last = F.floor((F.col("high") - F.col("low") - 1) / BLOCK)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    first = F.col("low") + 1 + F.col("block") * BLOCK
    rows = rows.withColumn("depth", F.explode(F.sequence(first, F.least(first + BLOCK - 1, F.col("high")))))
    sizes = prefixes.select(F.col("rep").alias("node_rep"), (F.col("pos") + 1).alias("depth"), F.col("total").alias("before"))
    rows = rows.join(sizes, ["node_rep", "depth"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    end = F.col("depth") == F.col("high")
    return rows.select(
        # Inside an edge nothing ends: a key that no node has, and no two rows share.
        F.when(end, F.col("id1")).otherwise(F.xxhash64("node_rep", "depth")).alias("id1"),
        F.when(end, F.col("id2")).otherwise(F.col("depth")).alias("id2"),
        F.col("m").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("low") + 1, F.col("up_m")).otherwise(F.col("m")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(end, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("x") - F.col("n") * F.col("before") - F.col("y") + F.col("before") - F.col("low_total")).alias("saved_tokens"),
    )


def trie(conversations: DataFrame, *, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the trie."""
    convs, rows = rebuilt(ranked_turns(conversations), family, shared)
    whole = rows.groupBy("conv_id").agg(F.bit_xor("x1").alias("h1"), F.bit_xor("x2").alias("h2"))
    zero = F.lit(0).cast("bigint")
    members = convs.join(whole, "conv_id", "left")
    members = staged(members.select("conv_id", "length", F.coalesce("h1", zero).alias("h1"), F.coalesce("h2", zero).alias("h2")), "members")
    distinct = members.groupBy("h1", "h2").agg(
        F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("length").alias("length")
    )
    distinct = staged(distinct, "distinct")
    reps = distinct.select(F.col("rep").alias("conv_id"))
    every = prefixes_of(rows.join(reps, "conv_id", "left_semi").withColumnRenamed("conv_id", "rep"))
    prefixes = _side(every)
    nodes = build(distinct, every, prefixes)

    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    sums = {"n_children": 0, "n_leaves": 1, "saved_tokens": 0}
    found = None
    if nodes is not None:
        tree = subtrees(nodes, distinct, prefixes)
        found = expanded(tree, members.agg(F.min("conv_id")).first()[0], prefixes)
        saved = F.sum(F.col("x") - F.col("y"))
        sums = tree.where("low = 0").agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("n_leaves"), saved.alias("saved_tokens")
        ).first().asDict()
    root = root.select(
        zero.alias("id1"),
        zero.alias("id2"),
        "conv_id",
        zero.alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        "n_convs",
        *[F.lit(v).cast("bigint").alias(k) for k, v in sums.items()],
    )
    found = root if found is None else found.unionByName(root)
    return found.join(end_digests(members), ["id1", "id2"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"),
    )


SQL = f"""
WITH t AS (
    SELECT conv_id AS c, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
           length(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS rank FROM t),
n AS (
    SELECT c, count(*) AS n, c - c % {FAMILY} AS base,
           xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
                                       list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                           lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
                                                    lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))),
               4294967295) % {SHARED} AS h
    FROM t GROUP BY c),
f AS (SELECT n.*, least(n.h, coalesce(o.n, 0)) AS taken FROM n LEFT JOIN n o ON n.base = o.c),
m AS (
    SELECT f.c, r.rank - f.h + f.taken AS pos, r.k, r.size FROM f JOIN r USING (c) WHERE r.rank > f.h
    UNION ALL
    SELECT f.c, r.rank AS pos, r.k, r.size FROM f JOIN r ON f.base = r.c WHERE r.rank <= f.taken),
s AS (
    SELECT f.c, coalesce(list(m.k ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS k,
           coalesce(list(m.size ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS size
    FROM f LEFT JOIN m USING (c) GROUP BY f.c),
p AS (
    SELECT c, d, array_to_string(k[1:d], ' ') AS key, array_to_string(k[1:d - 1], ' ') AS up, CASE WHEN d > 0 THEN size[d] ELSE 0 END AS size
    FROM (SELECT *, unnest(range(len(k) + 1)) AS d FROM s)),
v AS (SELECT key, any_value(d) AS d, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(size) AS size FROM p GROUP BY key),
w AS (
    SELECT v.*, coalesce(children, 0) AS children
    FROM v LEFT JOIN (SELECT up AS key, count(*) AS children FROM v WHERE d > 0 GROUP BY up) USING (key)),
u AS (
    SELECT p.key, count(*) FILTER (WHERE w.children = 0) AS n_leaves, sum((w.n - 1) * w.size) AS saved
    FROM w JOIN p ON p.c = w.c AND p.d <= w.d GROUP BY p.key),
e AS (SELECT array_to_string(k, ' ') AS key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM s GROUP BY key)
SELECT w.c AS conv_id, CAST(w.d AS BIGINT) AS depth, CASE WHEN w.d > 0 THEN o.c END AS parent_conv_id, w.n AS n_convs,
       w.children AS n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM w JOIN u USING (key) LEFT JOIN v o ON o.key = w.up LEFT JOIN e ON e.key = w.key
"""
