"""Streaming ingest: parsed events to a table of events, and messages as they stand.

The event table is the only state that must last: messages are a function of it. A micro-batch is
written under its batch id, so one that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.operators.parsing import parse_events
from parlance.operators.revisions import current_messages, distinct_events


def deduplicated(events: DataFrame, within: str | None = None, time: str = "arrived_at") -> DataFrame:
    """The first of each event id: for good, or (bounded state) for ``within`` of event time."""
    if within:
        return events.withWatermark(time, within).dropDuplicatesWithinWatermark(["id"])
    return events.dropDuplicates(["id"])


def _put(batch: DataFrame, path: str, number: int) -> None:
    rows = batch.withColumn("seq", F.monotonically_increasing_id()) if "seq" not in batch.columns else batch
    rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch_id={number}")


def ingest(events: DataFrame, path: str, checkpoint: str, available_now: bool = True, mode: str = "append") -> StreamingQuery:
    """Append events to the table at ``path``, batch by batch, each in a folder of its own."""
    writer = events.writeStream.foreachBatch(lambda batch, number: _put(batch, path, number)).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_events(events: DataFrame, path: str, number: int) -> None:
    """The batch form: of ``events`` (id and more), those that neither earlier batches nor earlier rows have.

    The batch is one folder, written at once; run again after a failure, it replaces itself. Rows
    that repeat an id within the batch are one event, any of them.
    """
    spark, new = events.sparkSession, events.dropDuplicates(["id"])
    if number:
        known = spark.read.parquet(path).where(F.col("batch_id") < number)
        new = new.join(known.select("id"), "id", "left_anti")
    _put(new, path, number)


def ingest_counted(parsed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store the events of a stream of parsed events that have records and are new, and count what comes, in one pass.

    The counts are observed while a batch is written, so nothing is parsed or read again for them. A batch leaves
    its rows and its counts in folders of its own: one that runs again after a failure replaces both.
    """
    gone = F.col("kind").isin("skipped", "invalid")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        came, kept = Observation(), Observation()
        seen = batch.observe(came, F.count("*").alias("received"), F.count_if(gone).alias("skipped"))
        new = seen.where(~gone).dropDuplicates(["id"])
        if number and (known := _earlier(spark, f"{path}/events", number)) is not None:
            new = new.join(known.select("id"), "id", "left_anti")
        is_message = F.col("kind").isin("message", "edit", "delete")
        _put(new.observe(kept, F.count("*").alias("stored"), F.count_if(is_message).alias("messages"), F.count_if(F.col("kind") == "reaction").alias("reactions")), f"{path}/events", number)
        counts = came.get | kept.get
        counts["duplicates"] = counts["received"] - counts["skipped"] - counts["stored"]
        row = spark.range(1).select(*[F.lit(counts[c]).cast("long").alias(c) for c in COUNTS])
        row.write.mode("overwrite").parquet(f"{path}/counts/batch_id={number}")

    return parsed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COUNTS = ("received", "stored", "messages", "reactions", "skipped", "duplicates")


def _earlier(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What batches before this one have stored; none if there is no such batch."""
    try:
        return spark.read.parquet(path).where(F.col("batch_id") < number)
    except AnalysisException:
        return None


def counted(spark: SparkSession, path: str) -> DataFrame:
    """One row: the counts of all batches of :func:`ingest_counted` together."""
    rows = spark.read.parquet(f"{path}/counts")
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS])


def keep_latest(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A small table of running figures: every batch writes all of it into a folder of its own."""
    writer = rows.writeStream.foreachBatch(lambda batch, number: _put(batch, path, number)).outputMode("complete")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """What the last batch of :func:`keep_latest` wrote."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch").alias("_last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("_last", "batch", "batch_id", "seq")


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """Distinct events in the order of arrival, as (batch, seq)."""
    rows = spark.read.parquet(path).drop("batch_id").withColumn("arrival", F.struct("batch", "seq"))
    return distinct_events(rows, "arrival")


def replay(spark: SparkSession, path: str, chats: list[str]) -> DataFrame:
    """Current messages, rebuilt from all stored events."""
    return current_messages(parse_events(stored_events(spark, path), chats), "arrival")


REVISION = "key string, revision long, seq long, body string"


def upserts(revisions: DataFrame) -> DataFrame:
    """Current revisions as a stream of updates. ``revisions``: key, revision, seq, body.

    State is one row for each key: the newest (revision, seq), with the time of the batch that brought it. An aggregate
    in update mode repeats what holds for every key that comes again; of these only what this batch brought is an
    update. So older ones that come later change nothing and give no update, nor does one that comes twice, and a
    deletion may come before what it deletes. Keys are added up by Spark: none costs a call of Python.
    """
    # within a micro-batch the current time is one value, and a batch that runs again has the same
    now = F.unix_micros(F.current_timestamp())
    timed = revisions.withColumn("came", -now)
    best = timed.groupBy("key").agg(F.max(F.struct("revision", "seq", "came", "body")).alias("b")).where(F.col("b.came") == -now)
    return best.select("key", "b.revision", "b.seq", "b.body")


def running_counts(parsed: DataFrame) -> DataFrame:
    """Events by kind so far."""
    return parsed.groupBy("kind").agg(F.count("*").alias("n"))


def turn_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Generations out of a stream of their events: one row for each once no event of it can come any more.

    ``events``: turn_id, at, kind (``start``, ``token``, ``end`` or ``cancel``), place (of the event in its turn).
    A turn's events are a session by event time: after ``gap`` without one it is over, by timeout if neither an end
    nor a cancellation has come. Events that come twice count once; those later than ``late`` don't count. Columns:
    turn_id, started_at, first_token_ms, tokens, seconds, rate (tokens a second, null without time), outcome.
    """
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["turn_id", "place"])
    when = lambda kind, pick: pick(F.when(F.col("kind") == kind, F.col("at")))
    per = once.groupBy("turn_id", F.session_window("at", gap).alias("w")).agg(
        F.min("at").alias("started_at"),
        F.max("at").alias("last_at"),
        when("token", F.min).alias("first_at"),
        F.count_if(F.col("kind") == "token").alias("tokens"),
        F.max(F.when(F.col("kind") == "cancel", 2).when(F.col("kind") == "end", 1).otherwise(0)).alias("state"),
    )
    seconds = (F.unix_micros("last_at") - F.unix_micros("started_at")) / 1e6
    outcome = F.when(F.col("state") == 2, "cancelled").when(F.col("state") == 1, "done").otherwise("timeout")
    first = (F.unix_micros("first_at") - F.unix_micros("started_at")) / 1e3
    return per.select("turn_id", "started_at", first.alias("first_token_ms"), "tokens", seconds.alias("seconds"), (F.col("tokens") / F.nullif(seconds, F.lit(0.0))).alias("rate"), outcome.alias("outcome"))
