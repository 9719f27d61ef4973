"""Work for all cores, where bytes don't tell how much work rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parts(spark: SparkSession) -> int:
    """As many parts as there are cores, or as a shuffle has if these are more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt to all cores: for few rows that are much work each, however few bytes they have."""
    return rows.repartition(parts(rows.sparkSession), *keys)


def split_scan(scan: DataFrame) -> DataFrame:
    """A plain scan of files in as many parts as there are cores; one that has as many splits already stays as it is, unshuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
