"""Positions in a global order without a single-partition window.

Rows are dealt out by key range and numbered within each range; the ranges' row counts, one for
each partition, turn these into global numbers. No window ever spans more than one range, so
neither a table nor one hot key has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.plans.durable import materialized


def global_rank(df: DataFrame, keys: list[Column], name: str = "rank", counted: Column | None = None) -> DataFrame:
    """``df`` with a running number from 1 in the order of ``keys`` (which should be unique).

    With ``counted``, the number of rows up to this one, itself included, where it holds.
    """
    one = F.lit(1) if counted is None else counted.cast("int")
    columns = df.columns
    ordered = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_one", one)
    # range bounds come from a sample, so both uses below need the same rows in the same ranges
    dealt = materialized(ordered)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.sum("_one").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_upto", F.sum("_one").over(within))
    return placed.join(F.broadcast(starts), "_part").select(*columns, (F.col("_start") + F.col("_upto")).cast("long").alias(name))
