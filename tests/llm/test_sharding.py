import random
import zlib

from palimpsest.llm import sharding

from .conftest import documents


def test_shards_are_near_equal_and_slots_gapless(spark, given):
    rows = sharding.assign(spark.read.parquet(f"{given}/documents.parquet")).toPandas()
    size = rows.groupby("shard")["size"].sum()
    assert set(rows["shard"]) == set(range(8)) and size.max() - size.min() <= 2 + size.sum() // 1000
    assert all(sorted(s) == list(range(len(s))) for _, s in rows.groupby("shard")["slot"])
    assert set(rows["law"]) == {"bytes"} and rows["grown_shard"].isna().all()


def test_defined_cases(spark):
    schema = "doc_id bigint, text string, size string, slot string, shard string"
    rows = [(1, "é"), (1, "é"), (2, None), (3, ""), (None, "x"), (4, "y" * 100_000)]
    got = sharding.assign(documents(spark, rows, schema), shards=2)
    out = sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got.collect())
    crc = zlib.crc32("é".encode())
    assert out[1:3] == [(1, 3, crc), (1, 3, crc)]
    assert (2, 1, None) in [(r["doc_id"], r["size"], r["text_crc32"]) for r in got.collect()]
    assert out[0] == (0, 2, zlib.crc32(b"x")) and out[-1][1] == 100_001
    assert sharding.assign(documents(spark, [])).count() == 0


def test_maps_are_versions_and_reruns_agree(spark, given, root):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    one = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(docs, root=root).collect()}
    assert one == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(docs.repartition(3)).collect()}
    first, second = (
        [r["shard"] for r in sharding.load_map(spark, root, v).orderBy("virtual_slot").collect()] for v in (1, 2)
    )
    assert first == sharding.first_map(sharding.SLOTS, 8) and len(second) == len(first)
    assert sum(a == b for a, b in zip(first, second, strict=True)) > 0.8 * len(first)


def test_rebalancing_and_growing():
    rng = random.Random(1)
    for sizes in ([0] * 64, [1] * 64, [rng.randint(0, 1000) for _ in range(512)], [10**6, *[1] * 63]):
        out = sharding.rebalanced(sharding.first_map(len(sizes), 8), sizes, 8)
        load = [sum(s for s, o in zip(sizes, out, strict=True) if o == k) for k in range(8)]
        if max(sizes) * 8 <= sum(sizes):
            assert max(load) - min(load) <= 2
        else:
            assert max(load) <= max(sizes) + 1
        grown = sharding.grown_map(out, sizes, 8)
        assert all(a == b or b == 8 for a, b in zip(out, grown, strict=True))
        new = sum(s for s, o in zip(sizes, grown, strict=True) if o == 8)
        assert new <= sum(sizes) / 9 and (max(sizes) * 9 > sum(sizes) or new >= 0.8 * sum(sizes) / 9)


def test_repeated_and_null_ids_are_balanced(spark):
    rows = [(None, "x" * 100) for _ in range(1600)] + [(i, "y" * 100) for i in range(400)]
    rows += [(7, f"{i} {'z' * 90}") for i in range(400)]
    got = sharding.assign(documents(spark, rows)).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() - load.min() <= 0.01 * load.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])


def test_a_stored_map_is_edited_again(spark, root):
    docs = documents(spark, [(i, "w" * (i % 50)) for i in range(3000)])
    more = docs.unionByName(documents(spark, [(i, "w" * (i % 70)) for i in range(3000, 4000)]))
    assert {r["map_version"] for r in sharding.assign(docs, root=root).collect()} == {2}
    got = sharding.assign(more, root=root).toPandas()
    assert set(got["map_version"]) == {3} and sharding.newest_map(spark, root) == 3
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= 0.01 * load.mean()
    two, three = ([r["shard"] for r in sharding.load_map(spark, root, v).orderBy("virtual_slot").collect()] for v in (2, 3))
    assert 0 < sum(a != b for a, b in zip(two, three, strict=True)) < 0.3 * len(two)
    grown = sharding.assign(more, root=root, shards=9).toPandas()
    assert set(grown["map_version"]) == {4} and set(grown["shard"]) == set(range(9))
    fewer = sharding.assign(more, root=root, shards=3).toPandas()
    assert set(fewer["shard"]) == set(range(3))
