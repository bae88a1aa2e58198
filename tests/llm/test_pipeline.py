import duckdb
import pytest

import corpus_pipeline
from palimpsest.llm import decontamination, language, mixing, neardup
from palimpsest.llm.queries import oracle_sql, queries

from .conftest import SCHEMA, documents


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, given, name):
    df = queries()[name](spark, given).toPandas()
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{given}/{t}.parquet'")
    cur = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(r) for r in cur.fetchall()]
    got = [tuple(None if x != x else x for x in r) for r in df[columns].astype(object).itertuples(index=False)]
    assert len(got) and sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_others_return_rows(spark, given, name):
    assert queries()[name](spark, given).count() > 0


def test_stages_apply_their_operators(spark, given):
    docs, columns = spark.read.parquet(f"{given}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, given).cache()
        columns = docs.columns
        assert kept.columns == columns
        before, after = docs.toPandas(), kept.toPandas()
        if name == "language ID":
            rows = language.identify(docs).toPandas()
            runs = language.label_runs(docs, language.fit(language.sample(docs))).toPandas()
            sure = (runs["score"] * runs["n_words"]).groupby(runs["doc_id"]).sum() / runs.groupby("doc_id")["n_words"].sum()
            known = rows[rows["lang_pred"] != "und"]["doc_id"]
            good = [i for i in known if sure[i] >= corpus_pipeline.LEAST_SCORE]
            assert sorted(after["doc_id"]) == sorted(good) and len(after) >= 0.9 * len(before)
            assert set(rows[rows["score"] >= corpus_pipeline.LEAST_SCORE]["doc_id"]) <= set(after["doc_id"])
        elif name == "near-dedup":
            rows = neardup.near_duplicates(docs).where("kept").toPandas()
            assert sorted(after["doc_id"]) == sorted(rows["doc_id"]) and len(after) < len(before)
        elif name == "decontamination":
            rows = decontamination.decontaminate(docs, spark.read.parquet(f"{given}/benchmark.parquet")).toPandas()
            assert sorted(after["doc_id"]) == sorted(rows[~rows["contaminated"]]["doc_id"])
        else:
            rows = mixing.mix(docs, whole_documents=True).toPandas()
            times = rows.set_index("doc_id")["copies"]
            assert after["doc_id"].value_counts().to_dict() == times[times > 0].to_dict()
        texts = before.drop_duplicates("doc_id").set_index("doc_id")["text"]
        assert (after["text"].values == texts[after["doc_id"]].values).all()
        docs = kept
    out = corpus_pipeline.run(spark, given).toPandas()
    assert sorted(out["doc_id"]) == sorted(docs.toPandas()["doc_id"])
    spark.catalog.clearCache()


def test_stages_on_odd_rows(spark, given):
    rows = [(1, None), (2, ""), (3, "123"), (None, "the of and to"), (5, "the of and to in that", None, None, 3)]
    rows += [rows[4], (6, "the of and " * 20_000, "en", "a", 1), (7, "that is the one of them", "en", None, 2)]
    for name, stage in corpus_pipeline.STAGES:
        for some in (rows, []):
            out = stage(spark, documents(spark, some), given)
            assert out.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ") or name == "sharding"
            assert out.count() <= 3 * max(len(some), 0)
