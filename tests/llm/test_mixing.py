import pytest

from palimpsest.llm import mixing

from .conftest import SCHEMA, documents, words


def filled(sizes, weights, cap):
    """Clamp, share the excess by weight, until none is above."""
    target, free, left = {}, dict(zip(sizes, weights, strict=True)), float(sum(sizes.values()))
    while free:
        level = left / sum(free.values())
        over = [s for s, w in free.items() if w * level > cap * sizes[s]]
        if not over:
            return target | {s: w * level for s, w in free.items()}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            del free[s]
    return target


@pytest.mark.parametrize("sizes", [[10, 1000, 5], [1, 1, 1, 500, 2, 9], [0, 7, 0], [40], [3, 3, 900, 3, 3, 3, 3]])
def test_water_filling_is_the_clamping_loop(spark, sizes):
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    rows = spark.createDataFrame([(False, s, n) for s, n in named.items()], "null_source boolean, source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.water_filled(rows).collect()}
    want = filled(named, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    assert got == pytest.approx(want)


def test_every_source_gets_its_target(spark):
    rows = [(i, " ".join(words(3 + i % 40, i)), None, ("a", "b", None, "c")[i % 7 % 4]) for i in range(300)]
    rows += [(1000, None, None, "a"), (1001, "", None, "z"), (1002, " \n", None, None), rows[0], rows[0]]
    schema = SCHEMA + ", size string, target string, before string, part string"
    docs = documents(spark, rows, schema)
    got = mixing.mix(docs, keep=("doc_id", "source")).toPandas()
    assert len(got) == len(rows)
    for _, one in got.groupby("source", dropna=False):
        assert abs(one["taken"].sum() - one["target"].iloc[0]) <= 0.5
        assert one["source_size"].iloc[0] == one["size"].sum()
    assert (got["taken"] <= 3 * got["size"]).all() and got["target"].notna().all()
    again = mixing.mix(docs.repartition(5), keep=("doc_id", "source")).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))
    whole = mixing.mix(docs, whole_documents=True).toPandas()
    assert (whole["taken"] == whole["copies"] * whole["size"]).all()
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mixed_documents_are_whole_copies(spark):
    docs = documents(spark, [(i, " ".join(words(10, i)), "xx", "ab"[i % 2], 1) for i in range(40)])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.exceptAll(docs).count() >= 0
    counts = out.groupBy("doc_id", "text", "source").count().toPandas()
    assert counts["count"].max() <= 3 and out.select("doc_id", "text").distinct().join(docs, ["doc_id", "text"]).count() == len(counts)
