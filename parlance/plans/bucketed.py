"""Tables that lie in buckets by a key, so that joins and groups on it need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from parlance.plans.durable import fresh_path

BUCKETS = 64


def bucketed(df: DataFrame, key: str, *order: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """``df`` written in buckets by ``key``, sorted by it and ``order`` in each, and read back.

    The one shuffle is that of the write; whoever joins or groups by ``key`` afterwards reads bucket by bucket.
    Tables with equal numbers of buckets meet without an exchange on either side.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    # one task for each bucket, so that a bucket is one file and keeps its order
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key, *order).option("path", path or fresh_path(spark, name)).saveAsTable(name)
    return spark.table(name)
