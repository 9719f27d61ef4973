"""A corpus pipeline of five stages; each gets what its predecessor kept, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontam, langid, mixing, sharding, simhash
from parlance.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go.

    So do null, empty and letterless texts, and all if no row has a language to learn from. Rows that repeat stay or go
    together; an empty table stays empty.
    """
    return langid.drop_rejected(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id, null ids last.

    Null, empty and blank texts are one group. An empty table stays empty.
    """
    return simhash.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; null and empty texts are not contaminated, and nothing is without a benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains that are too frequent are thinned out to the target weights.

    A row is kept or not by its posterior and a hash of its id, so rows that repeat stay or go together; rows without an
    id share a draw. Without labels all rows stay; an empty table stays empty.
    """
    labelled = table(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    return mixing.resample(docs, labelled)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a shard and a slot in it; equal texts, null ones among them, share a shard."""
    return sharding.assign_shards(docs)


STAGES = [("language", identify_language), ("near_dedup", drop_near_copies), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Fingerprints, clusters and projected gradients can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
