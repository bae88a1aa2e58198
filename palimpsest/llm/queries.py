"""The registered queries of this package, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, decontamination, hamming, language, mixing, neardup, scoring, sharding, substrings, topk, trie, warc


def _given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_given(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_given(spark, sf_dir, "documents"))


def op3_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_given(spark, sf_dir, "documents"), order=3, leave_out=True)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_given(spark, sf_dir, "conversations"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_given(spark, sf_dir, "documents"), _given(spark, sf_dir, "benchmark"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _given(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_given(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.capture_histories(_given(spark, sf_dir, "pages"))
    digest = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return captures.select(*digest, "position", "url_key", "captured_at")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_given(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_given(spark, sf_dir, "documents")).drop("copies")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(_given(spark, sf_dir, "conversations"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_given(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _given(spark, sf_dir, "embeddings")
    return hamming.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_sharding, op2_language, op3_scoring, op4_chat, op5_decontamination, op6_topk, op7_substrings, op8_warc, op9_neardup, op10_mixing, op11_trie, op12_alignment, op13_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontamination.SQL, "op6_topk": topk.SQL, "op7_substrings": substrings.SQL, "op8_warc": warc.SQL, "op9_neardup": neardup.SQL, "op10_mixing": mixing.SQL, "op11_trie": trie.SQL}
