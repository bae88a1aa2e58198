import hashlib
import heapq
import random

import duckdb
import pyarrow as pa
import pytest

from palimpsest.llm import warc

PAGES = "page_id bigint, url string, html string, digest string, kept string"


def test_loser_tree_merges_like_a_sort():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((rng.randrange(50), rng.randrange(3)) for _ in range(rng.randrange(0, 40))) for _ in range(k)]
        out = list(warc.LoserTree([iter(r) for r in runs]))
        assert [x for x, _ in out] == list(heapq.merge(*runs))
        assert out == sorted(out)


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://www.Example.com/A?B=c", "com,example,www)/a?b=c"),
        ("https://example.org:8080", "org,example:8080)/"),
        ("http://example.org:80/x#top", "org,example)/x"),
        ("no url", "no url"),
        ("http://[bad", "http://[bad"),
        ("", ""),
    ],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


@pytest.fixture(scope="module")
def pages():
    rng, big = random.Random(3), "x" * 999 + "é"
    rows = [(i, f"http://h{i % 7}.example.com/{rng.randrange(9)}", "p%d " % (i % 40) * 300) for i in range(200)]
    rows += [(300, "http://a.com/\r\nX: 1", "a\r\n\r\nWARC/1.1\r\n\r\n b"), (301, None, None), (302, "u", ""), (303, "u", big)]
    rows += [(304, "u", big), (305, "u", "x" * 999), (306, "u", "x" * 999), (304, "u", big), (None, "u", big), (307, "v", "y" * 400_000)]
    return [(*r, None, None) for r in rows]


def test_round_trip(spark, pages, root):
    out = warc.capture_histories(spark.createDataFrame(pages, PAGES), f"{root}/w")
    got = sorted((repr(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect())
    best = {}
    for i, _, html, *_ in pages:
        best.setdefault(html or "", []).append(i)
    want = []
    for i, _, html, *_ in pages:
        data = (html or "").encode()
        same = [x for x in best[html or ""] if x is not None]
        again = len(data) >= 1000 and len(best[html or ""]) > 1 and i != max(same)
        want.append((repr(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert got == sorted(want)
    text = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{root}/w")
    assert text.count() >= 1


@pytest.mark.parametrize("range_rows", [100_000, 5])
def test_histories_are_in_one_order(spark, pages, root, range_rows):
    warc.write_archives(spark.createDataFrame(pages, PAGES).repartition(4), f"{root}/w")
    runs = warc.read_runs(spark, f"{root}/w")
    assert runs.select("run").distinct().count() >= 4
    rows = warc.merge_runs(runs, range_rows=range_rows).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(pages)))
    keys = [warc.order_of((r["url_key"], r["captured_at"], r["page_id"])) for r in rows]
    assert keys == sorted(keys)


def test_archives_are_bounded(spark, root):
    """Large payloads do not share an archive; every record comes back."""
    sizes = [100] * 30 + [70_000] * 65 + [1_100_000] * 2
    rows = [(i, "http://a.com/", chr(97 + i % 26) * (n - 4) + f"{i:04}", None, None) for i, n in enumerate(sizes)]
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"{root}/w")
    runs = warc.read_runs(spark, f"{root}/w").groupBy("run").agg({"payload_bytes": "sum", "seq": "count"}).collect()
    assert sorted(r["count(seq)"] for r in runs) == [1, 1, 1, 30, 64]
    assert all(r["sum(payload_bytes)"] <= 64 << 20 for r in runs)


def test_keys_and_places_against_sql(spark):
    rows = [
        (i, url, "x", None, None)
        for i, url in enumerate(
            ["http://B.a.com:80/Q?R=s#t", "https://b.a.com:8080", "http://u:p@b.a.com/", "//b.a.com?x", "no url", "", None, "http://z.com:443/a b", "ftp://é.org/é?", "a:b"]
        )
    ]
    out = warc.capture_histories(spark.createDataFrame(rows, PAGES)).select("page_id", "position", "url_key", "captured_at")
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}))
    want = con.execute(f"SELECT page_id, position, url_key, captured_at FROM ({warc.SQL})").fetchall()
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_damage_is_seen(spark, pages, root):
    good = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.records(good.encode()))[0][1] == b"abc"
    with pytest.raises(ValueError):
        list(warc.records(good.replace("3", "2").encode()))
    fields = {"warc-type": "response", "warc-record-id": "<urn:page:1>", "warc-payload-digest": "sha1:0", "warc-target-uri": "u", "warc-date": ""}
    with pytest.raises(ValueError):
        warc.capture(fields, b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx")


def test_empty_table(spark):
    assert warc.capture_histories(spark.createDataFrame([], PAGES)).count() == 0
