"""Causal context: for each target, the last messages of its chat that stood before it was sent.

A message counts from the moment its last change is over, so what a chat shows only grows. One scan in the
order (chat, time of the last change) is enough: it keeps the K newest visible messages of the chat at hand
and answers each target as it passes. The order is cut into ranges of about equal size, whatever chats they
hold. A chat that goes on from one range to the next takes its K newest messages along: each range tells those
of its last chat, and a fold over the ranges of a chat, K rows each, gives every range what it starts with.
"""

from __future__ import annotations

from heapq import heappush, heappushpop

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from parlance.operators.selection import available_before
from parlance.plans.durable import materialized

#: Kinds of rows in the scan, in the order in which they count at the same time: what a range starts with, then
#: targets, then messages, since a message of the very time of a target doesn't count.
CARRIED, ASKED, SAID = 0, 1, 2


def _scan(k: int, bounded: bool):
    """Rows (part, chat, kind, id, sent_at, target_id, bound_at, bound_id) in order to (target_id, id, sent_at, nth)."""

    def run(batches):
        import pyarrow as pa

        here, newest = None, []
        for batch in batches:
            plain = [(c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c).to_pylist() for c in batch.columns]
            targets, ids, sent, nth = [], [], [], []
            for part, chat, kind, own, at, target, *bound in zip(*plain, strict=True):
                if here != (part, chat):
                    here, newest = (part, chat), []
                if kind != ASKED:
                    (heappush if len(newest) < k else heappushpop)(newest, (at, own))
                    continue
                after = tuple(bound) if bounded and bound[0] is not None else None
                seen = sorted((x for x in newest if after is None or x > after), reverse=True)
                targets += [target] * len(seen)
                sent += [x[0] for x in seen]
                ids += [x[1] for x in seen]
                nth += range(1, len(seen) + 1)
            kinds = (batch.schema.field("target_id").type, batch.schema.field("id").type, pa.int64(), pa.int32())
            out = [pa.array(x, t) for x, t in zip((targets, ids, sent, nth), kinds, strict=True)]
            out[2] = out[2].cast(batch.schema.field("sent_at").type)
            yield pa.RecordBatch.from_arrays(out, names=["target_id", "id", "sent_at", "nth"])

    return run


def _fold(k: int):
    """The newest messages of a chat by range to what each later range of the chat starts with."""

    def run(table):
        from heapq import nlargest
        from itertools import groupby

        import pyarrow as pa

        rows = table.select(["part", "sent_at", "id", "place"])
        held, out = [], {"part": [], "place": []}
        order = rows.append_column("at", rows.column("sent_at").cast(pa.int64())).sort_by("part")
        for part, group in groupby(zip(*(order.column(c).to_pylist() for c in ("part", "at", "id", "place")), strict=True), key=lambda r: r[0]):
            mine = list(group)
            if mine[0][3] > 0:  # not the first range of the chat
                out["part"] += [part] * len(held)
                out["place"] += held
            held = nlargest(k, [*held, *((at, own) for _, at, own, _ in mine if own is not None)])
        kinds = (table.schema.field("sent_at").type, table.schema.field("id").type)
        at, own = ([x[i] for x in out["place"]] for i in (0, 1))
        chat = table.column("chat")[0]
        return pa.table({"part": pa.array(out["part"], pa.int32()), "chat": pa.array([chat.as_py()] * len(own), chat.type), "sent_at": pa.array(at, pa.int64()).cast(kinds[0]), "id": pa.array(own, kinds[1])})

    return run


def last_k(messages: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """``target_id, id, sent_at, nth`` (1 is the newest) of at most ``k`` messages per target.

    ``messages``: id, chat, sent_at, edited_at, deleted_at. ``targets``: target_id, chat, at and
    optionally bound_at, bound_id: only messages after that key count. Messages at the very time
    of the target don't. Rows with a null chat or time take no part, nor do messages without an id.
    """
    bounded = "bound_at" in targets.columns
    t = targets.where("chat IS NOT NULL AND at IS NOT NULL")
    m = messages.where("chat IS NOT NULL AND sent_at IS NOT NULL AND id IS NOT NULL").join(t.select("chat").distinct(), "chat", "left_semi")
    of = {f.name: f.dataType for f in (*m.select("id", "sent_at").schema, *t.schema)}
    none = lambda c: F.lit(None).cast(of[c]).alias(c)
    bounds = ["bound_at", "bound_id"] if bounded else []
    said = m.select("chat", F.greatest("sent_at", "edited_at", "deleted_at").alias("at"), F.lit(SAID).alias("kind"), "id", "sent_at", none("target_id"), *[none(c) for c in bounds])
    asked = t.select("chat", "at", F.lit(ASKED).alias("kind"), none("id"), none("sent_at"), "target_id", *bounds)
    order = ["chat", "at", "kind", "id", "target_id"]
    # ranges are drawn from a sample, so what follows needs the same rows in the same ranges
    dealt = materialized(said.union(asked).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    whole = Window.partitionBy("chat")
    # a chat that lies in several ranges is the last of all of these but its last one: two rows a range at most
    ends = dealt.groupBy("part").agg(F.min("chat").alias("first"), F.max("chat").alias("last"))
    edges = ends.select("part", F.explode(F.array_distinct(F.array("first", "last"))).alias("chat"))
    edges = materialized(edges.withColumn("n", F.count("*").over(whole)).withColumn("place", F.col("part") - F.min("part").over(whole)).where("n > 1"))
    newest = Window.partitionBy("part", "chat").orderBy(F.desc("sent_at"), F.desc("id"))
    tops = dealt.where(F.col("kind") == SAID).join(edges.select("part", "chat"), ["part", "chat"], "left_semi").withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= k)
    known = edges.join(tops.select("part", "chat", "sent_at", "id"), ["part", "chat"], "left").select("part", "chat", "place", "sent_at", "id")
    fields = {f.name: f.dataType for f in dealt.schema}
    carried = known.groupBy("chat").applyInArrow(_fold(k), StructType([StructField(c, fields[c]) for c in ("part", "chat", "sent_at", "id")]))
    start = carried.select("chat", F.lit(None).cast(fields["at"]).alias("at"), F.lit(CARRIED).alias("kind"), "id", "sent_at", none("target_id"), *[none(c) for c in bounds], "part")
    columns = ["part", "chat", "kind", "id", "sent_at", "target_id", *bounds]
    ready = dealt.union(start.select(*dealt.columns)).repartition("part").sortWithinPartitions("part", F.asc_nulls_first("chat"), F.asc_nulls_first("at"), "kind").select(*columns)
    schema = StructType([StructField("target_id", of["target_id"]), StructField("id", of["id"]), StructField("sent_at", of["sent_at"]), StructField("nth", IntegerType())])
    return ready.mapInArrow(_scan(k, bounded), schema)


def last_k_by_range(messages: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """The same by a plain range join: simpler, for small tables and as a check."""
    m = messages.select("id", F.col("chat").alias("m_chat"), "sent_at", "edited_at", "deleted_at")
    seen = available_before(F.col("at"), F.col("sent_at"), F.col("edited_at"), F.col("deleted_at"))
    after = F.lit(True)
    if "bound_at" in targets.columns:
        after = F.col("bound_at").isNull() | (F.struct("sent_at", "id") > F.struct(F.col("bound_at"), F.col("bound_id")))
    joined = targets.join(m, (F.col("chat") == F.col("m_chat")) & seen).where(after)
    newest = Window.partitionBy("target_id").orderBy(F.desc("sent_at"), F.desc("id"))
    return joined.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= k).select("target_id", "id", "sent_at", "nth")


def context_reactions(context: DataFrame, reactions: DataFrame, targets: DataFrame) -> DataFrame:
    """Reactions to a target's context messages that came before the target: ``target_id, event_id, id, sent_at``."""
    r = reactions.select("event_id", F.col("message_id").alias("id"), F.col("sent_at").alias("r_at"))
    times = targets.select("target_id", "at")
    return context.select("target_id", "id").join(r, "id").join(times, "target_id").where("r_at < at").select("target_id", "event_id", "id", F.col("r_at").alias("sent_at"))


def timeline(context: DataFrame, reactions: DataFrame) -> DataFrame:
    """Messages and reactions of each target in one order: time, messages first, id. ``nth`` counts from 1."""
    both = context.select("target_id", "sent_at", F.lit(0).alias("kind"), F.col("id").cast("string").alias("item"))
    both = both.union(reactions.select("target_id", "sent_at", F.lit(1).alias("kind"), F.col("event_id").cast("string").alias("item")))
    order = Window.partitionBy("target_id").orderBy("sent_at", "kind", "item")
    return both.withColumn("nth", F.row_number().over(order))


def disjoint_violations(index: DataFrame) -> DataFrame:
    """Sources used by several splits: ``source, n_splits``. ``index``: split, target_id, context (array)."""
    used = index.select("split", F.explode(F.concat(F.array("target_id"), "context")).alias("source"))
    return used.groupBy("source").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")
