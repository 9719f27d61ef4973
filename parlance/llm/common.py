"""What the operators share: durable intermediate tables, packed rows, graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, a temporary folder is set for the session, but only with a local master:
    on a cluster other machines would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, losing an executor
    afterwards costs nothing, and the sizes of the files let AQE choose and split joins."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parlance-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A top-level column, whatever signs its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def pack(docs: DataFrame, *columns: str) -> DataFrame:
    """``row`` (all columns as one struct) beside the named ones, renamed c0, c1, ...

    Operators that pass whole rows through Python use it so that columns of the caller can't
    clash with theirs.
    """
    return docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), *[column(c).alias(f"c{i}") for i, c in enumerate(columns)])


def row_with(packed: DataFrame, more: str) -> StructType:
    """The schema of ``row`` and more columns, whatever the caller's columns are called."""
    return StructType([packed.schema["row"], *StructType.fromDDL(more).fields])


def row_field(name: str) -> Column:
    """A field of ``row``."""
    return F.col("row").getField(name)


def kept_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The caller's columns out of ``row``."""
    return rows.select(*[row_field(c).alias(c) for c in docs.columns])


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: ``(node, root)``, root the smallest node.

    ``edges`` has two long columns. Alternates "large star" and "small star" steps (Kiveris et al.,
    2014), each a min-aggregate with map-side combine and one join, until nothing changes; that is
    logarithmic in the component size in practice. Every step is written to the shared folder.
    Node values are compared as signed longs. Loops and repeated edges are ignored; nodes with null
    are dropped. Nodes without an edge are not in the result.
    """
    u, v = edges.columns
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    e = stored(e)
    before = _tally(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        e = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = stored(e.groupBy("u").agg(F.min("v").alias("m")))
        near = e.join(low, "u")
        e = stored(near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v"))).distinct())
        after = _tally(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
