import hashlib
import zlib

import duckdb
import pytest

from palimpsest.llm import trie
from palimpsest.llm.queries import op11_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_force(rows, family=100, shared=6):
    """The nodes by plain dictionaries of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, who in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(who) - 1) * len(k[-1][1]) if k else 0
    return sorted(
        (
            min(who),
            len(k),
            min(members[k[:-1]]) if k else None,
            len(who),
            children[k],
            leaves[k],
            saved[k],
            hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest(),
        )
        for k, who in members.items()
    )


def nodes(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], SCHEMA)


def test_query_against_brute_force_and_sql(spark, given):
    rows = [tuple(r) for r in spark.read.parquet(f"{given}/conversations.parquet").collect()]
    got = nodes(op11_trie(spark, given))
    assert got == brute_force(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{given}/conversations.parquet'")
    assert sorted(con.execute(trie.SQL).fetchall()) == got


CASES = {
    "nulls": [(1, None, None, None), (1, 0, "", ""), (1, 1, "user", "é🙂"), (None, 0, "user", "x"), (2, None, "", None)],
    "turnless": [(c, 0, "user", "short") for c in range(101, 130)],
    "copies": [(c, t, "user", f"same {t}") for c in range(0, 400) for t in range(9)],
    "ties and repeats": [(7, 0, "user", "b"), (7, 0, "user", "a"), (7, 0, "user", "a"), (7, 1, "x", "long " * 9000)],
    "negative": [(c, t, "user", f"{c % 3} {t}") for c in (-250, -205, -200, -5, -1, 0, 3, 99) for t in range(7)],
    # Each conversation leaves the one before one turn later.
    "caterpillar": [(c * 100, t, "user", "on" if t < c else f"out {c}") for c in range(40) for t in range(c + 1 + c % 3)],
    "prefixes of each other": [(c * 100, t, "user", str(t)) for c in range(30) for t in range(c)],
    "every first turn the same": [(c * 100, t, "user", "hello" if t == 0 else f"{c % 5} {t % (c % 7 + 1)}") for c in range(60) for t in range(6)],
}


@pytest.mark.parametrize("name", CASES)
def test_defined_cases(spark, name):
    df = conversations(spark, CASES[name]).repartition(5)
    assert nodes(trie.trie(df)) == brute_force(CASES[name])


def test_empty(spark):
    assert nodes(trie.trie(conversations(spark, []))) == []


def test_blocks_of_a_long_conversation(spark, monkeypatch):
    """Pieces smaller than the data, so that ranks, hashes, edges and digests are put together from several."""
    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "MEMBERS", 16)
    monkeypatch.setattr(trie, "BROADCAST_ROWS", 0)
    rows = [(500, t, "user", f"{t % 11}") for t in range(90)] + [(500 + c, t, "user", f"{t % 11}") for c in range(1, 60) for t in range(40 + c % 5)]
    df = conversations(spark, rows).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert nodes(trie.trie(df)) == brute_force(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_two_fattest(spark):
    rows = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    got = spark.createDataFrame(rows, "a bigint, b bigint").select("a", "b", trie.fattest("a", "b").alias("f")).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_a_batch_looks_up_all_prefixes_at_once(spark):
    """The plan of a batch does not grow with the longest conversation, whose joins the driver holds."""
    def joins(n):
        every = spark.createDataFrame([(1, d, d, d, d) for d in range(1, n + 1)], "rep bigint, pos bigint, h1 bigint, h2 bigint, total bigint")
        pending = spark.createDataFrame([(1, n, n, n, 0)], "rep bigint, length bigint, h1 bigint, h2 bigint, at bigint")
        nodes = spark.createDataFrame([], ", ".join(f"{c} bigint" for c in [*trie.NODE, "key1", "key2", "first1", "first2"]))
        plans, staged = [], trie.staged
        trie.staged = lambda df, what: plans.append(df) or staged(df, what)
        try:
            located = trie.locate(pending, nodes, every, every)
        finally:
            trie.staged = staged
        assert [(r["rep"], r["at"]) for r in located.collect()] == [(1, 0)]
        return plans[0]._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(3000) == joins(3) <= 6
