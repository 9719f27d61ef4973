"""The store and bucketed tables, over the parsed envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import parsing as p
from parlance.operators import revisions as rv
from parlance.operators.store import CODEC, MessageStore
from parlance.plans.bucketed import bucketed
from parlance.plans.durable import fresh_path, materialized
from parlance.queries.ingest import CHATS, CURRENT, EXPECTED, REVISIONS, parsed, raw_events, revision_log
from parlance.queries.registry import query

BUCKETS = 16


@query(f"WITH {CURRENT} SELECT message_id, author_id, sent_ms, event_id AS seq, kind FROM cur")
def store_scan_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current messages out of a table in buckets, in the order of time."""
    m = bucketed(rv.current_messages(parsed(spark, sf_dir), "seq").drop("payload"), "message_id", "sent_at", buckets=BUCKETS)
    return rv.scan_messages(m).select("message_id", "author_id", F.unix_millis("sent_at").alias("sent_ms"), "seq", "kind")


@query(f"WITH {CURRENT} SELECT c.message_id, count(r.event_id) AS n_reactions, coalesce(max(r.event_id), -1) AS newest FROM cur c LEFT JOIN (SELECT * FROM x WHERE kind = 'reaction') r ON r.message_id = c.message_id GROUP BY c.message_id")
def store_message_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their reactions, bucket by bucket."""
    rows = materialized(parsed(spark, sf_dir).drop("payload"))
    seqs = rows.where("kind = 'reaction'").select("message_id", F.col("seq").cast("string").alias("event_id"), "sent_at", "chat_id", "author_id", "value", "removed")
    m = bucketed(rv.current_messages(rows, "seq"), "message_id", buckets=BUCKETS)
    r = bucketed(seqs, "message_id", "sent_at", "event_id", buckets=BUCKETS)
    newest = F.array_max(F.transform("reactions", lambda x: x["event_id"].cast("long")))
    return rv.with_children(m, r).select("message_id", F.size("reactions").cast("long").alias("n_reactions"), F.coalesce(newest, F.lit(-1)).alias("newest"))


@query(f"WITH r AS ({REVISIONS}) SELECT message_id, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY revision_at DESC, seq DESC) AS n FROM r) WHERE n = 1")
def store_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest revision of every message, out of a table in buckets by message."""
    log = bucketed(revision_log(spark, sf_dir), "message_id", "revision_at", "seq", buckets=BUCKETS)
    return rv.latest_revision(log, "message_id", "revision_at", "seq").select("message_id", "seq", "kind", "value")


class Killed(Exception):
    """What a writer dies of between its folders and its manifest."""


def _die() -> None:
    raise Killed


def filled(spark: SparkSession, sf_dir: str) -> MessageStore:
    """Three batches of events, the second sent again with some of the first; the third's first writer dies."""
    store = MessageStore(spark, fresh_path(spark, "store"), BUCKETS)
    rows = materialized(parsed(spark, sf_dir), CODEC)
    batches = [rows.where("seq % 3 = 0"), rows.where("seq % 3 = 1 OR seq % 6 = 0"), rows.where("seq % 3 = 2")]
    store.commit(batches[0], batch=0)
    store.commit(batches[1], batch=1)
    store.commit(batches[1], batch=1)
    try:
        store.commit(batches[2], batch=2, before_manifest=_die)
    except Killed:
        store.commit(batches[2], batch=2)
    return store


@query(f"WITH {CURRENT} SELECT message_id, event_id AS seq, kind, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS version FROM cur")
def store_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current messages of a store that was filled by commits, with the version that brought each."""
    store = filled(spark, sf_dir)
    return store.messages().select("message_id", "seq", "kind", "version")


@query(f"WITH {CURRENT}, m AS (SELECT 'message' AS kind, user_id % 10 AS chat FROM cur UNION ALL SELECT 'reaction', user_id % 10 FROM x WHERE kind = 'reaction') SELECT mode, kind, count(*) FILTER (WHERE chat < 7 OR mode = 'kept') AS n FROM m, (VALUES ('kept'), ('gone')) v(mode) GROUP BY ALL")
def store_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events parsed anew, with one chat less: its messages and reactions stay at first, then go."""
    store = filled(spark, sf_dir)
    found = None
    for mode, keep in (("kept", True), ("gone", False)):
        changed = store.reindex(lambda events: p.parse_events(events, CHATS[:7]), keep_stale=keep)
        if keep and any(changed.values()):
            raise ValueError("nothing was to change")
        for kind, rows in (("message", store.messages()), ("reaction", store.reactions())):
            n = materialized(rows.agg(F.lit(mode).alias("mode"), F.lit(kind).alias("kind"), F.count("*").alias("n")))
            found = n if found is None else found.union(n)
    return found


@query(f"WITH {EXPECTED} SELECT message_id, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ms DESC, event_id DESC) AS n FROM x WHERE kind IN ('message', 'edit', 'delete') AND event_id % 3 < 2) WHERE n = 1")
def store_old_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store as of its second version, read after the third was put in place."""
    return filled(spark, sf_dir).messages(2).select("message_id", "seq")
