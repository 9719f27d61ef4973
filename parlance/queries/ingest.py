"""Parsing and revisions, over envelopes that the table ``events`` is turned into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import variants as v
from parlance.operators import parsing as p
from parlance.operators import revisions as rv
from parlance.plans.durable import fresh_path, materialized
from parlance.plans.fence import fenced
from parlance.plans.spread import parts, split_scan
from parlance.queries.registry import query, table
from parlance.sources import events as src
from parlance.streaming import ingest as st

CHATS = [f"g{i}" for i in range(8)]

#: One envelope per event. Clicks are messages with a mention behind an emoji, purchases edit and
#: errors delete what was sent a minute before, signups react to it, views have no text; every
#: seventh comes from the own account, every fifth within a call.
ENVELOPE = """
    WITH e AS (
        SELECT event_id, ts, unix_millis(CAST(ts AS TIMESTAMP)) AS ms, user_id, event_type, value, props, to_json(named_struct('x', props)) AS q,
               concat('"groupInfo":{"groupId":"g', user_id % 10, '"}') AS g, event_id % 7 = 0 AS own
        FROM {events}),
    d AS (
        SELECT *, CASE event_type
            WHEN 'click' THEN concat('"message":', substring(q, 6, length(q) - 6), ',"mentions":[{"start":0,"length":1,"uuid":"u', user_id + 1, '","name":" @Ann  Lee "}],"attachments":[{"id":"a', event_id, '"}]')
            WHEN 'purchase' THEN concat('"message":"edited ', event_id, '"', CASE WHEN event_id % 2 = 0 THEN concat(',"quote":{"id":', ms - 120000, ',"author":"u', user_id + 2, '","text":"was"}') ELSE '' END)
            WHEN 'error' THEN concat('"remoteDelete":{"timestamp":', ms - 60000, '}')
            WHEN 'signup' THEN concat('"reaction":{"emoji":"👍","targetAuthorUuid":"","targetAuthor":"u', user_id + 1, '","targetSentTimestamp":', ms - 60000, CASE WHEN event_id % 2 = 1 THEN ',"isRemove":true' ELSE '' END, '}')
            ELSE '"message":null' END AS body
        FROM e),
    m AS (
        SELECT *, concat('{', g, ',"timestamp":', ms, ',', body, '}') AS data FROM d),
    v AS (
        SELECT *, concat('{"source":"u', user_id, '","sourceName":"N', user_id % 3, '","timestamp":', ms, ',',
            CASE WHEN event_type = 'purchase' THEN concat('"editMessage":{"targetSentTimestamp":', ms - 60000, ',"dataMessage":', data, '}')
                 WHEN own THEN concat('"syncMessage":{"sentMessage":', data, '}') ELSE concat('"dataMessage":', data) END, '}') AS env
        FROM m)
    SELECT event_id AS seq, user_id, event_type, own, ms, CASE WHEN event_id % 5 = 0
        THEN concat('{"method":"receive","params":{"account":"me","envelope":', env, '}}')
        ELSE concat('  {"account":"me","envelope":', env, '} ') END AS value
    FROM v
"""

#: What parsing must make of it, for DuckDB. An own message has no uuid, so its author is the account.
EXPECTED = """
    e AS (SELECT *, (epoch_us(ts) // 1000) AS ms, event_type <> 'purchase' AND event_id % 7 = 0 AS own FROM events),
    a AS (SELECT *, 'signal-chat:' || sha256('g' || (user_id % 10)) AS chat_id,
                 'signal-person:' || sha256(CASE WHEN own THEN 'me' ELSE 'u' || user_id END) AS author_id,
                 'signal-person:' || sha256('u' || (user_id + 1)) AS other_id,
                 CASE WHEN event_type = 'view' OR user_id % 10 >= 8 THEN 'skipped'
                      WHEN event_type = 'purchase' THEN 'edit' WHEN event_type = 'error' THEN 'delete'
                      WHEN event_type = 'signup' THEN 'reaction' ELSE 'message' END AS kind,
                 CASE WHEN event_type = 'click' THEN ms ELSE ms - 60000 END AS sent_ms
          FROM e),
    x AS (SELECT *, CASE WHEN kind <> 'skipped' THEN 'signal-message:' || sha256(chat_id || chr(0) || CASE WHEN kind = 'reaction' THEN other_id ELSE author_id END || chr(0) || sent_ms) END AS message_id FROM a)
"""


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = ENVELOPE.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}")
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, payload, seq`` as a source would give them, in as many splits as there are cores."""
    lines = split_scan(envelopes(spark, sf_dir))
    line = F.trim("value")
    return lines.select(F.concat(F.lit("signal:"), F.sha2(line, 256)).alias("id"), line.alias("payload"), "seq")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.parse_events(raw_events(spark, sf_dir), CHATS)


def _root(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fenced(envelopes(spark, sf_dir), p.read_root(p.unwrap_rpc(F.try_parse_json("value"))).alias("r")).withColumn("e", F.col("r.envelope"))
    return fenced(rows, p.read_data(p.select_payload(F.col("e"))).alias("d"))


@query(f"WITH {EXPECTED} SELECT event_id, kind, message_id, CASE WHEN kind <> 'skipped' THEN chat_id END AS chat_id, CASE WHEN kind <> 'skipped' THEN author_id END AS author_id, CASE WHEN kind <> 'skipped' THEN CASE WHEN kind = 'reaction' THEN ms ELSE sent_ms END END AS sent_ms FROM x")
def parse_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select(F.col("seq").alias("event_id"), "kind", "message_id", "chat_id", "author_id", F.unix_millis("sent_at").alias("sent_ms"))


@query("SELECT event_id, props AS text FROM events")
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' JSON written as lines, with blank lines between, and read again."""
    e = table(spark, sf_dir, "events")
    path = fresh_path(spark, "lines")
    lines = e.select(F.explode(F.array(F.concat(F.lit("  "), F.to_json(F.struct("event_id", "props"))), F.lit("   "))).alias("value"))
    lines.write.text(path)
    got = src.read_events(spark, path).where("payload IS NOT NULL")
    return got.select(F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"), F.get_json_object("payload", "$.props").alias("text"))


@query("SELECT 'g' || user_id AS id, 'name ' || user_id AS name, user_id % 3 <> 0 AND user_id % 4 <> 0 AS active FROM (SELECT DISTINCT user_id FROM events)")
def list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    body = F.to_json(F.struct(F.concat(F.lit("g"), u).alias("id"), F.concat(F.lit("name "), u).alias("name"), F.when(u % 3 == 0, False).alias("isMember"), F.when(u % 4 == 0, True).alias("isBlocked")))
    return src.list_groups(users.select(body.alias("value")))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS nth FROM events")
def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with their place in the order (time, id)."""
    from parlance.plans.ordering import global_rank

    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return global_rank(e, [F.col("ts"), F.col("event_id")], "nth").select("event_id", "nth")


@query("SELECT event_id, 'u' || user_id AS source FROM events")
def unwrap_rpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(spark, sf_dir).select(F.col("seq").alias("event_id"), v.text(F.col("e.source")).alias("source"))


@query("SELECT event_id, 'g' || (user_id % 10) AS group_id, event_type = 'purchase' AS is_edit, CASE WHEN event_type = 'purchase' THEN (epoch_us(ts) // 1000) - 60000 END AS target FROM events")
def select_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _root(spark, sf_dir)
    t = p.edit_target(F.col("e"))
    return r.select(F.col("seq").alias("event_id"), v.text(F.col("d.groupInfo.groupId")).alias("group_id"), t.isNotNull().alias("is_edit"), t.alias("target"))


@query(f"WITH {EXPECTED} SELECT event_id FROM x WHERE user_id % 10 < 8")
def filter_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = v.text(F.col("d.groupInfo.groupId"))
    return _root(spark, sf_dir).where(group.isin(CHATS)).select(F.col("seq").alias("event_id"))


@query("SELECT event_id, CASE WHEN event_type <> 'purchase' AND event_id % 7 = 0 THEN 'me' ELSE 'u' || user_id END AS author FROM events")
def resolve_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _root(spark, sf_dir).select(F.col("seq").alias("event_id"), p.resolve_author(F.col("e"), F.col("r")).alias("author"))


@query("SELECT event_id, 'signal-chat:' || sha256('g' || (user_id % 10)) AS chat_id, 'signal-person:' || sha256('u' || user_id) AS person_id, 'signal-message:' || sha256('signal-chat:' || sha256('g' || (user_id % 10)) || chr(0) || 'signal-person:' || sha256('u' || user_id) || chr(0) || (epoch_us(ts) // 1000)) AS message_id FROM events")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    chat = p.hashed("chat", F.concat(F.lit("g"), F.col("user_id") % 10))
    person = p.hashed("person", F.concat(F.lit("u"), F.col("user_id")))
    return e.select("event_id", chat.alias("chat_id"), person.alias("person_id"), p.message_key(chat, person, F.col("ms")).alias("message_id"))


@query("SELECT event_id, 'signal-person:' || sha256('u' || (user_id + 1)) AS person_id, 0 AS start, 1 AS length, 'Ann Lee' AS name FROM events WHERE event_type = 'click' AND user_id % 10 < 8")
def parse_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = parsed(spark, sf_dir).where("kind = 'message'").select(F.col("seq").alias("event_id"), F.inline("mentions"))
    return m.select("event_id", "person_id", "start", "length", "name")


@query("SELECT doc_id, sha256(nullif(trim(regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^@+', ''), '\\s+', ' ', 'g')), '')) AS digest FROM documents")
def mention_name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(p.mention_name(F.col("text")), 256).alias("digest"))


@query(f"WITH {EXPECTED} SELECT event_id, 'signal-message:' || sha256(chat_id || chr(0) || 'signal-person:' || sha256('u' || (user_id + 2)) || chr(0) || (ms - 120000)) AS reply_to, 'was' AS quote FROM x WHERE kind = 'edit' AND event_id % 2 = 0")
def parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark, sf_dir).where("quote IS NOT NULL")
    return rows.select(F.col("seq").alias("event_id"), F.col("quote.reply_to").alias("reply_to"), F.col("quote.text").alias("quote"))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ms, strftime(ts, '%Y-%m-%d') AS day FROM events")
def millis_to_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    at = p.millis_to_ts(F.col("ms"))
    return e.select("event_id", F.unix_millis(at).alias("ms"), F.date_format(at, "yyyy-MM-dd").alias("day"))


REVISIONS = "SELECT CAST(floor(event_id / 3.0) AS BIGINT) AS message_id, event_id AS seq, ts AS revision_at, CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'edit' ELSE 'original' END AS kind, value FROM events"


def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REVISIONS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@query(f"WITH r AS ({REVISIONS}) SELECT message_id, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY revision_at DESC, seq DESC) AS n FROM r) WHERE n = 1")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.latest_revision(revision_log(spark, sf_dir), "message_id", "revision_at", "seq").select("message_id", "seq", "kind", "value")


def twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event comes a second time, later."""
    p_ = parsed(spark, sf_dir)
    return p_.withColumn("order", F.col("seq")).union(p_.where("seq % 3 = 0").withColumn("order", F.col("seq") + 1_000_000_000))


@query(f"WITH {EXPECTED}, y AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS n FROM x) SELECT CAST(sum(n) AS BIGINT) AS received, count(*) FILTER (WHERE kind <> 'skipped') AS stored, count(*) FILTER (WHERE kind IN ('message', 'edit', 'delete')) AS messages, count(*) FILTER (WHERE kind = 'reaction') AS reactions, CAST(sum(n) FILTER (WHERE kind = 'skipped') AS BIGINT) AS skipped, CAST(coalesce(sum(n - 1) FILTER (WHERE kind <> 'skipped'), 0) AS BIGINT) AS duplicates FROM y")
def harvest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.harvest_counts(twice(spark, sf_dir), "order")


@query(f"WITH {EXPECTED} SELECT count(*) AS scanned, count(*) FILTER (WHERE kind <> 'skipped') AS updated, count(*) FILTER (WHERE kind IN ('message', 'edit', 'delete')) AS messages, count(*) FILTER (WHERE kind = 'reaction') AS reactions, count(*) FILTER (WHERE kind = 'skipped') AS skipped FROM x")
def reindex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.reindex_counts(parsed(spark, sf_dir))


CURRENT = f"""{EXPECTED}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ms DESC, event_id DESC) AS n FROM x WHERE kind IN ('message', 'edit', 'delete')) WHERE n = 1)"""


@query(f"WITH {CURRENT} SELECT message_id, author_id, sent_ms, event_id AS seq, kind FROM cur")
def scan_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rv.scan_messages(rv.current_messages(parsed(spark, sf_dir), "seq"))
    return m.select("message_id", "author_id", F.unix_millis("sent_at").alias("sent_ms"), "seq", "kind")


@query(f"WITH {CURRENT} SELECT c.message_id, count(r.event_id) AS n_reactions, coalesce(max(r.event_id), -1) AS newest FROM cur c LEFT JOIN (SELECT * FROM x WHERE kind = 'reaction') r ON r.message_id = c.message_id GROUP BY c.message_id")
def join_message_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialized(parsed(spark, sf_dir))
    seqs = rows.where("kind = 'reaction'").select("message_id", F.col("seq").cast("string").alias("event_id"), "sent_at", "chat_id", "author_id", "value", "removed")
    m = rv.with_children(rv.current_messages(rows, "seq"), seqs)
    newest = F.array_max(F.transform("reactions", lambda r: r["event_id"].cast("long")))
    return m.select("message_id", F.size("reactions").cast("long").alias("n_reactions"), F.coalesce(newest, F.lit(-1)).alias("newest"))


@query(f"WITH {CURRENT} SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM cur) AS messages, (SELECT count(*) FROM x WHERE kind = 'reaction') AS reactions")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # parsed once for all three counts
    rows = materialized(parsed(spark, sf_dir).drop("payload"))
    return rv.store_stats(rows, rv.current_messages(rows, "seq"), rv.current_reactions(rows))


@query("SELECT event_id AS id FROM events WHERE event_id % 4 <> 0")
def anti_new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return rv.new_events(e, e.where("id % 4 = 0"))


@query(f"WITH {CURRENT} SELECT message_id, event_id AS seq, kind FROM cur")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same current messages by way of a stream: files, micro-batches, stored events, replay."""
    base = fresh_path(spark, "ingest")
    files = _files_of_batch(spark, 3)
    lines = raw_events(spark, sf_dir).repartitionByRange(3 * files, "seq").sortWithinPartitions("seq")
    lines.select(F.to_json(F.struct("id", "payload", "seq")).alias("value")).write.text(f"{base}/in")
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2 * files).text(f"{base}/in")
    rows = stream.select(F.from_json("value", "id string, payload string, seq long").alias("r")).select("r.id", "r.payload", F.col("r.seq").alias("place"))
    st.ingest(rows, f"{base}/events", f"{base}/checkpoint").awaitTermination()
    # files may be read in any order, so revisions of the same time are told apart by their place
    stored = st.stored_events(spark, f"{base}/events").withColumnRenamed("place", "order")
    return rv.current_messages(p.parse_events(stored, CHATS), "order").select("message_id", F.col("order").alias("seq"), "kind")


@query(f"WITH r AS ({REVISIONS}) SELECT CAST(message_id AS VARCHAR) AS key, seq FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY revision_at DESC, seq DESC) AS n FROM r) WHERE n = 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions that come in any order, several batches, through keyed state."""
    base = fresh_path(spark, "upsert")
    log = revision_log(spark, sf_dir).select(F.col("message_id").cast("string").alias("key"), F.unix_micros(F.col("revision_at").cast("timestamp")).alias("revision"), "seq", F.col("kind").alias("body"))
    files = _files_of_batch(spark, 4)
    log.repartition(4 * files, F.xxhash64("seq")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(st.REVISION).option("maxFilesPerTrigger", 2 * files).parquet(f"{base}/in")
    out = st.upserts(stream)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/n={number}")

    out.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(f"{base}/out")
    return changes.groupBy("key").agg(F.max_by("seq", "batch").alias("seq"))


def _files_of_batch(spark: SparkSession, batches: int) -> int:
    """Files of each of so many micro-batches, so that all cores write them and no task holds a batch."""
    return -(-parts(spark) // batches)


def _stream_of(spark: SparkSession, rows: DataFrame, base: str, name: str = "in", batches: int = 3) -> DataFrame:
    """``rows`` as a stream that comes in several micro-batches, of several files each."""
    files = _files_of_batch(spark, batches)
    rows.repartitionByRange(batches * files, rows.columns[-1]).write.mode("append").parquet(f"{base}/{name}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/{name}")


@query(f"WITH {EXPECTED} SELECT kind, count(*) AS n FROM x GROUP BY kind")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind so far, updated batch by batch; the table holds what the last batch left."""
    base = fresh_path(spark, "counts")
    counts = st.running_counts(p.parse_events(_stream_of(spark, raw_events(spark, sf_dir), base), CHATS))
    st.keep_latest(counts, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return st.latest(spark, f"{base}/out")


@query(f"WITH {EXPECTED}, y AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS n FROM x) SELECT CAST(sum(n) AS BIGINT) AS received, count(*) FILTER (WHERE kind <> 'skipped') AS stored, count(*) FILTER (WHERE kind IN ('message', 'edit', 'delete')) AS messages, count(*) FILTER (WHERE kind = 'reaction') AS reactions, CAST(sum(n) FILTER (WHERE kind = 'skipped') AS BIGINT) AS skipped, CAST(coalesce(sum(n - 1) FILTER (WHERE kind <> 'skipped'), 0) AS BIGINT) AS duplicates FROM y")
def stream_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their repetitions come as a stream, before and after a restart; what comes is counted while it is stored."""
    base = fresh_path(spark, "harvest")
    raw = raw_events(spark, sf_dir)
    for rows in (raw, raw.where("seq % 3 = 0")):
        stream = p.parse_events(_stream_of(spark, rows, base), CHATS)
        st.ingest_counted(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return st.counted(spark, f"{base}/out")


@query("WITH e AS (SELECT CAST(event_id AS VARCHAR) AS turn_id, ts, event_id % 9 AS n, event_type = 'error' AS stopped, event_id % 4 = 0 AS lost FROM events) SELECT turn_id, CASE WHEN n > 0 THEN 500.0 END AS first_token_ms, n AS tokens, CASE WHEN stopped THEN 'cancelled' WHEN lost THEN 'timeout' ELSE 'done' END AS outcome FROM e")
def stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation for every event: a start, tokens twice a second, some of which come twice, and an end, a cancellation or nothing."""
    e = split_scan(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"))
    n = (F.col("event_id") % 9).cast("int")
    last = F.when(F.col("event_type") == "error", "cancel").when(F.col("event_id") % 4 == 0, F.lit(None)).otherwise("end")
    step = F.posexplode(F.concat(F.array(F.lit("start")), F.array_repeat(F.lit("token"), n), F.array_compact(F.array(last)))).alias("place", "kind")
    steps = e.select(F.col("event_id").cast("string").alias("turn_id"), F.col("ts").cast("timestamp").alias("t"), step)
    steps = steps.withColumn("at", F.timestamp_micros(F.unix_micros("t") + F.col("place") * 500_000)).select("turn_id", "at", "kind", "place")
    base = fresh_path(spark, "turns")
    steps.union(steps.where("place % 3 = 1")).write.parquet(f"{base}/in")
    # long after all others: they let the windows before them close
    end = lambda days: steps.agg(F.lit("end").alias("turn_id"), (F.max("at") + F.make_interval(days=F.lit(days))).alias("at"), F.lit("start").alias("kind"), F.lit(0).alias("place"))
    stream = spark.readStream.schema(steps.schema).parquet(f"{base}/in")
    for run in range(1, 4):
        query_ = st.turn_sessions(stream, "60 seconds", "10 seconds").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query_.awaitTermination()
        end(run).write.mode("append").parquet(f"{base}/in")
    return spark.read.parquet(f"{base}/out").where("turn_id <> 'end'").select("turn_id", F.col("first_token_ms"), "tokens", "outcome")


@query("SELECT user_id % 50 AS id, 1 AS n FROM events GROUP BY user_id % 50")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every content comes once out of a stream that repeats it in all of its batches, before and after a restart."""
    base = fresh_path(spark, "dedup")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("id"), F.col("event_id").alias("seq"))
    for part in (0, 1):
        stream = _stream_of(spark, e.where(F.col("seq") % 2 == part), base)
        st.ingest(st.deduplicated(stream), f"{base}/events", f"{base}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{base}/events")
    return got.groupBy("id").agg(F.count("*").cast("int").alias("n"))


@query("SELECT user_id % 50 AS id, 1 AS n FROM events GROUP BY user_id % 50")
def stream_dedup_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with state that is given up ten years of event time after an id came first."""
    base = fresh_path(spark, "dedup")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("id"), F.col("ts").cast("timestamp").alias("arrived_at"), F.col("event_id").alias("seq"))
    for part in (0, 1):
        stream = _stream_of(spark, e.where(F.col("seq") % 2 == part), base)
        st.ingest(st.deduplicated(stream, "3650 days"), f"{base}/events", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/events").groupBy("id").agg(F.count("*").cast("int").alias("n"))


@query(f"WITH r AS ({REVISIONS}), k AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY revision_at DESC, seq DESC) AS n FROM r) SELECT CAST(message_id AS VARCHAR) AS key, seq, 0 AS late FROM k WHERE n = 1")
def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest revisions first, deletions among them; older ones, which come after a restart, change nothing.

    ``late`` counts the changes that the second run made.
    """
    base = fresh_path(spark, "late")
    log = revision_log(spark, sf_dir).select(F.col("message_id").cast("string").alias("key"), F.unix_micros(F.col("revision_at").cast("timestamp")).alias("revision"), "seq", F.col("kind").alias("body"))
    newest = rv.latest_revision(log, "key", "revision", "seq").select("key", "revision", "seq", "body")
    for run, rows in enumerate((newest, log.join(newest.select("key", "seq"), ["key", "seq"], "left_anti").select("key", "revision", "seq", "body"))):
        stream = _stream_of(spark, rows, base)
        st.ingest(st.upserts(stream).withColumn("run", F.lit(run)), f"{base}/out", f"{base}/checkpoint", mode="update").awaitTermination()
    changes = spark.read.parquet(f"{base}/out")
    return changes.groupBy("key").agg(F.max_by("seq", F.struct("batch", "revision")).alias("seq"), F.count_if(F.col("run") > 0).cast("int").alias("late"))


@query(f"WITH {CURRENT} SELECT message_id, author_id, sent_ms FROM cur")
def replay_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events are stored by a stream, some twice; the messages are rebuilt from the store alone."""
    base = fresh_path(spark, "replay")
    raw = raw_events(spark, sf_dir)
    for rows in (raw, raw.where("seq % 3 = 0")):
        st.ingest(_stream_of(spark, rows, base), f"{base}/events", f"{base}/checkpoint").awaitTermination()
    return st.replay(spark, f"{base}/events", CHATS).select("message_id", "author_id", F.unix_millis("sent_at").alias("sent_ms"))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS batch FROM events")
def sink_event_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, of which the second repeats all of the first and itself: each event is stored once, where it came first."""
    path = fresh_path(spark, "store")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    st.append_events(e.where("id % 2 = 0"), path, 0)
    st.append_events(e.union(e), path, 1)
    return spark.read.parquet(path).select("id", F.col("batch").cast("int").alias("batch"))
