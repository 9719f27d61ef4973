"""The current state of messages: the newest revision wins, whenever it arrives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def revision_at(sent: str = "sent_at", edited: str = "edited_at", deleted: str = "deleted_at") -> Column:
    return F.coalesce(deleted, edited, sent)


def latest_revision(rows: DataFrame, key: str, revision: str, seq: str) -> DataFrame:
    """The whole newest row of each key; of equal revisions the one with the larger ``seq``.

    An aggregate with map-side combine rather than a window, so a key with a large part of all
    rows shrinks before the shuffle.
    """
    whole = F.struct(*rows.columns)
    best = rows.groupBy(key).agg(F.max_by(whole, F.struct(revision, seq)).alias("_best"))
    return best.select(*[F.col(f"_best.{c}").alias(c) for c in rows.columns])


def distinct_events(events: DataFrame, order: str) -> DataFrame:
    """The first row of each event id, in the order of arrival."""
    whole = F.struct(*events.columns)
    first = events.groupBy("id").agg(F.min_by(whole, F.col(order)).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) for c in events.columns])


def new_events(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose id the store lacks."""
    return arriving.join(stored.select("id").distinct(), "id", "left_anti")


def current_messages(parsed: DataFrame, order: str) -> DataFrame:
    """Messages as they stand after all revisions; a deleted one stays as a tombstone without text."""
    rows = parsed.where(F.col("kind").isin("message", "edit", "delete")).withColumn("revision_at", revision_at())
    return latest_revision(rows, "message_id", "revision_at", order)


def current_reactions(parsed: DataFrame) -> DataFrame:
    """One row per reaction event."""
    return parsed.where("kind = 'reaction'").select(F.col("id").alias("event_id"), "message_id", "chat_id", "author_id", "value", "sent_at", "removed")


def with_children(messages: DataFrame, reactions: DataFrame) -> DataFrame:
    """Messages with their reactions as an array ordered by time and event; none is an empty array."""
    item = F.struct("sent_at", "event_id", "chat_id", "author_id", "value", "removed")
    grouped = reactions.groupBy("message_id").agg(F.array_sort(F.collect_list(item)).alias("reactions"))
    joined = messages.join(grouped, "message_id", "left")
    kind = grouped.schema["reactions"].dataType
    return joined.withColumn("reactions", F.coalesce("reactions", F.array().cast(kind)))


def harvest_counts(parsed: DataFrame, order: str) -> DataFrame:
    """One row: received, stored, messages, reactions, skipped, duplicates.

    Events without a record are skipped, however often they come; only others can be duplicates.
    """
    per_id = parsed.groupBy("id").agg(F.count("*").alias("n"), F.min_by("kind", F.col(order)).alias("kind"))
    gone = F.col("kind").isin("skipped", "invalid")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_id.agg(
        total(F.col("n")).alias("received"),
        F.count_if(~gone).alias("stored"),
        F.count_if(F.col("kind").isin("message", "edit", "delete")).alias("messages"),
        F.count_if(F.col("kind") == "reaction").alias("reactions"),
        total(F.when(gone, F.col("n")).otherwise(0)).alias("skipped"),
        total(F.when(~gone, F.col("n") - 1).otherwise(0)).alias("duplicates"),
    )


def reindex_counts(parsed: DataFrame) -> DataFrame:
    """One row: scanned, updated, messages, reactions, skipped, of a rebuild from stored events."""
    gone = F.col("kind").isin("skipped", "invalid")
    return parsed.agg(
        F.count("*").alias("scanned"),
        F.count_if(~gone).alias("updated"),
        F.count_if(F.col("kind").isin("message", "edit", "delete")).alias("messages"),
        F.count_if(F.col("kind") == "reaction").alias("reactions"),
        F.count_if(gone).alias("skipped"),
    )


def store_stats(events: DataFrame, messages: DataFrame, reactions: DataFrame) -> DataFrame:
    """One row with the number of events, current messages and reactions."""
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((events, "events"), (messages, "messages"), (reactions, "reactions"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


def scan_messages(messages: DataFrame, author: Column | None = None) -> DataFrame:
    """Current messages, of one author if given, ordered by time and id."""
    rows = messages if author is None else messages.where(F.col("author_id") == author)
    return rows.orderBy("sent_at", "message_id")
