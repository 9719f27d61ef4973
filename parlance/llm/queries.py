"""The operators applied to whole tables, and SQL that gives the same rows where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontam, embeddups, exactdup, langid, licenses, mixing, search, sharding, simhash, suffixdup, toolcalls, toxicity, whitening
from parlance.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_ids(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(table(spark, sf_dir, "documents"))


def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    return mixing.mixture(table(spark, sf_dir, "documents"), labelled)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_ids(table(spark, sf_dir, "documents"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.linked_dialogues(table(spark, sf_dir, "conversations"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddups.embedding_groups(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_langid, op3_decontaminate, op4_exact_dedup, op5_repeated_spans, op6_toxicity, op7_mixing, op8_licenses, op9_tool_calls, op10_sharding, op11_embedding_dedup, op12_whitening, op13_search)
}

ORACLE_SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_licenses": licenses.oracle_sql(),
    "op9_tool_calls": toolcalls.ORACLE_SQL,
    "op11_embedding_dedup": embeddups.ORACLE_SQL,
    "op13_search": search.ORACLE_SQL,
}
