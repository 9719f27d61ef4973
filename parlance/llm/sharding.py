"""Sharding: cut an ordered run of atomic groups where the largest shard is smallest.

Equal texts form a group, which is never split; groups are ordered by a digest of their text. The
smallest feasible capacity is found by search over the ordered group sizes, checked greedily: each
shard takes groups while they fit. Rows are range-partitioned and numbered in parallel, so a check
asks only for the last group end at or before a position; several capacities are checked at once.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import stored

#: Capacities that one round of the search tries at once.
TRIES = 24
#: Group ends that the driver holds at most (8 bytes each).
HELD = 100_000
LAW = "bytes"


def _numbered(batches):
    """Per partition, in order: running row number and bytes before the row."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, n, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        ends = total + np.cumsum(size)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part)), pa.array(n + np.arange(len(size))), pa.array(ends)], names=[*batch.schema.names, "part", "nth", "upto"])
        n += len(size)
        total = int(ends[-1]) if len(size) else total


def _search(ends: DataFrame, shards: int, total: int, largest: int) -> list[int]:
    """The cuts (ends of the shards) for the smallest capacity that is enough.

    A larger capacity never moves a cut to the left, so the cuts of two capacities bound all cuts
    between. Once at most HELD group ends lie within these bounds they are fetched and the search
    ends on the driver; until then each round halves the range TRIES times at once by aggregates.
    """

    def distributed(capacities: list[int]) -> list[list[int]]:
        at = [[0] for _ in capacities]
        for _ in range(shards):
            wanted = [a[-1] + c for a, c in zip(at, capacities, strict=True)]
            got = ends.where(F.col("upto") <= max(wanted)).agg(*[F.max(F.when(F.col("upto") <= w, F.col("upto"))).alias(f"c{i}") for i, w in enumerate(wanted)]).first()
            for a, x in zip(at, got, strict=True):
                a.append(max(a[-1], x or 0))
        return [a[1:] for a in at]

    def local(held: list[int], capacity: int) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            i = bisect_right(held, at + capacity)
            at = max(at, held[i - 1]) if i else at
            out.append(at)
        return out

    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest  # high is always enough
    bounds = [(j * (low - largest), j * high) for j in range(1, shards + 1)]
    while True:
        near = F.lit(False)
        for a, z in bounds:
            near = near | F.col("upto").between(a, z)
        if low == high or ends.where(near).count() <= HELD:
            held = sorted(r["upto"] for r in ends.where(near).select("upto").collect()) if low < high else None
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if local(held, mid)[-1] >= total else (mid + 1, high)
            return local(held, high) if held else distributed([high])[0]
        tried = sorted({low + (high - low) * i // TRIES for i in range(TRIES + 1)})
        found = distributed(tried)
        i = next(i for i, c in enumerate(found) if c[-1] >= total)
        low, high = (tried[i - 1] + 1 if i else tried[i]), tried[i]
        bounds = list(zip(found[i - 1] if i else found[i], found[i], strict=True))


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    A null text has size 1 and the checksum of no bytes; null and empty texts are one group. Rows
    that repeat an id and a text get slots of their own. Shards may stay empty if there are fewer
    groups than shards. An empty table gives an empty result; further columns are ignored. ``law``
    is ``bytes``; ``grown_shard`` is null under that law.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    ordered = rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    fields = [*ordered.schema.fields, *(T.StructField(n, T.LongType()) for n in ("part", "nth", "upto"))]
    numbered = stored(ordered.mapInArrow(_numbered, T.StructType(fields)))
    parts = sorted(numbered.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect())
    if not parts:
        return rows.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")).limit(0)
    starts, n, b = [], 0, 0
    for p, rows_in, bytes_in in parts:  # one entry for each partition
        starts.append((p, n, b))
        n, b = n + rows_in, b + bytes_in
    start = docs.sparkSession.createDataFrame(starts, "part long, first long, before long")
    placed = numbered.join(F.broadcast(start), "part").select("doc_id", "size", "text_crc32", "key", (F.col("first") + F.col("nth")).alias("row"), (F.col("before") + F.col("upto")).alias("upto"))
    groups = placed.groupBy("key").agg(F.max("upto").alias("upto"), F.sum("size").alias("bytes"), F.max("row").alias("last"))
    ends = stored(groups)
    largest = ends.agg(F.max("bytes")).first()[0]
    cut = _search(ends, shards, b, largest)
    # rows before each shard: those up to the group that ends at the cut before
    last = {r["upto"]: r["last"] + 1 for r in ends.where(F.col("upto").isin(cut)).collect()}
    before = [0, *(last.get(c, 0) for c in cut[:-1])]
    shard, first = F.lit(0), F.lit(0).cast("long")
    for i in range(1, shards):
        if cut[i - 1] < b:
            shard = F.when(F.col("upto") > cut[i - 1], i).otherwise(shard)
            first = F.when(F.col("upto") > cut[i - 1], F.lit(before[i]).cast("long")).otherwise(first)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), shard.cast("int").alias("shard"), (F.col("row") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the texts as Parquet, one folder per shard, in slot order; returns the assignment.

    Rows are told apart by a number of their own, so null and repeated ids are kept as they come; of equal texts any
    may come first.
    """
    own = F.monotonically_increasing_id().alias("rid")
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), own))
    placed = assign_shards(rows.select("rid", "text"), shards, "rid").withColumnRenamed("doc_id", "rid")
    whole = stored(rows.withColumnRenamed("id", "doc_id").join(placed, "rid").drop("rid"))
    out = whole.select("doc_id", "text", *[c for c in placed.columns if c != "rid"])
    out.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return out.drop("text")
