"""Dataset construction over ``events`` as messages: chat and author from the user, props as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import render as rd
from parlance.functions.json import canonical_object, value
from parlance.functions.unicode import units
from parlance.operators import artifacts
from parlance.operators import context as cx
from parlance.operators import dataset as ds
from parlance.operators import selection as sel
from parlance.plans.durable import fresh_path, materialized
from parlance.queries.registry import query, table

#: Times are cut to the minute, which makes ties; purchases are edited and errors deleted ten
#: minutes after they were sent, so they are invisible to targets in between.
MESSAGES = """
    SELECT event_id AS id, user_id % 10 AS chat, user_id AS author, date_trunc('minute', ts) AS sent_at,
           CASE WHEN event_type = 'purchase' THEN date_trunc('minute', ts) + INTERVAL 10 MINUTE END AS edited_at,
           CASE WHEN event_type = 'error' THEN date_trunc('minute', ts) + INTERVAL 10 MINUTE END AS deleted_at,
           CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '  ' ELSE props END AS text,
           CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS n_att, event_type, value, user_id FROM events
"""
TARGET, K = 7, 32
#: Whose messages are targets: one person who writes under many accounts, in half of the chats.
MINE = f"author % 16 = {TARGET}"
VALID, TEST = 0.1, 0.2
M = f"msg AS ({MESSAGES})"
WHY = "CASE WHEN deleted_at IS NOT NULL THEN 'deleted' WHEN edited_at IS NOT NULL THEN 'edited' WHEN n_att > 0 THEN 'attachment' WHEN text IS NULL THEN 'no_text' WHEN trim(text) = '' THEN 'no_visible_text' END"
SPLIT = f"""
    {M}, tgt AS (SELECT * FROM (SELECT *, {WHY} AS reason FROM msg WHERE {MINE}) WHERE reason IS NULL),
    n AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * {VALID}) AS BIGINT)) AS v, greatest(1, CAST(floor(count(*) * {TEST}) AS BIGINT)) AS t FROM tgt),
    r AS (SELECT tgt.*, row_number() OVER (ORDER BY sent_at, id) AS rk FROM tgt),
    sp AS (SELECT r.*, CASE WHEN rk <= n - v - t THEN 'train' WHEN rk <= n - t THEN 'valid' ELSE 'test' END AS split,
                  CASE WHEN rk <= n - v - t THEN rk - 1 WHEN rk <= n - t THEN rk - 1 - (n - v - t) ELSE rk - 1 - (n - t) END AS index FROM r, n),
    b AS (SELECT 'valid' AS split, (SELECT max(rk) FROM sp WHERE split = 'train') AS rk UNION ALL SELECT 'test', (SELECT max(rk) FROM sp WHERE split = 'valid')),
    bound AS (SELECT b.split, r.sent_at AS b_at, r.id AS b_id FROM b JOIN r USING (rk))
"""
CONTEXT = f"""
    {SPLIT}, seen AS (
        SELECT t.id AS target_id, m.id, m.sent_at, t.sent_at AS at, t.split, row_number() OVER (PARTITION BY t.id ORDER BY m.sent_at DESC, m.id DESC) AS nth
        FROM sp t LEFT JOIN bound ON bound.split = t.split
        JOIN msg m ON m.chat = t.chat AND m.sent_at < t.sent_at AND (m.edited_at IS NULL OR m.edited_at < t.sent_at) AND (m.deleted_at IS NULL OR m.deleted_at < t.sent_at)
             AND (b_at IS NULL OR m.sent_at > b_at OR (m.sent_at = b_at AND m.id > b_id))),
    ctx AS (SELECT * FROM seen WHERE nth <= {K}),
    react AS (SELECT event_id, event_id - 30 AS message_id, date_trunc('minute', ts) AS r_at, user_id FROM events WHERE event_type = 'signup'),
    cr AS (SELECT ctx.target_id, react.event_id, react.message_id, r_at FROM ctx JOIN react ON react.message_id = ctx.id WHERE r_at < ctx.at)
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSAGES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select("event_id", (F.col("event_id") - 30).alias("message_id"), (F.col("user_id") % 10).alias("chat"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("sent_at"), F.col("user_id").alias("author_id"))


def reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = messages(spark, sf_dir).where(MINE)
    return mine.withColumn("reason", sel.exclusion(F.col("text"), F.col("edited_at"), F.col("deleted_at"), F.col("n_att"), F.lit(0)))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.chronological_split(reasoned(spark, sf_dir).where("reason IS NULL"), "sent_at", "id", VALID, TEST)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialized(split(spark, sf_dir))
    bounds = sel.purge_bounds(rows, "sent_at", "id")
    return materialized(rows.join(F.broadcast(bounds), "split").select(F.col("id").alias("target_id"), "chat", F.col("sent_at").alias("at"), "bound_at", "bound_id", "split", "index"))


def context(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = targets(spark, sf_dir)
    return materialized(cx.last_k(messages(spark, sf_dir), t, K)), t


@query(f"WITH {CONTEXT} SELECT target_id, id, nth FROM ctx")
def join_causal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir)[0].select("target_id", "id", "nth")


@query(f"WITH {M} SELECT target_id, id, nth FROM (SELECT t.id AS target_id, m.id, row_number() OVER (PARTITION BY t.id ORDER BY m.sent_at DESC, m.id DESC) AS nth FROM msg t JOIN msg m ON m.chat = t.chat AND m.sent_at < t.sent_at AND (m.edited_at IS NULL OR m.edited_at < t.sent_at) AND (m.deleted_at IS NULL OR m.deleted_at < t.sent_at)) WHERE nth <= {K}")
def last_k_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every message's author could see when it was sent, in chats without bounds."""
    m = messages(spark, sf_dir)
    return cx.last_k(m, m.select(F.col("id").alias("target_id"), "chat", F.col("sent_at").alias("at")), K).select("target_id", "id", "nth")


@query(f"WITH {M} SELECT id, {WHY} AS reason FROM msg WHERE {MINE}")
def target_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasoned(spark, sf_dir).select("id", "reason")


@query(f"WITH {M}, w AS (SELECT {WHY} AS why FROM msg WHERE {MINE}) SELECT count(*) AS target_messages, count(*) FILTER (WHERE why IS NULL) AS included, count(why) AS excluded, " + ", ".join(f"count(*) FILTER (WHERE why = '{r}') AS {r}" for r in sel.REASONS) + " FROM w")
def target_selection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.selection_audit(reasoned(spark, sf_dir))


@query(f"WITH {SPLIT}, a AS (SELECT count(*) AS all_, count(*) FILTER (WHERE why IS NULL) AS inc FROM (SELECT {WHY} AS why FROM msg WHERE {MINE})) SELECT v.rule FROM a, (VALUES ('counts differ from the splits'), ('excluded differs from the reasons')) v(rule)")
def validate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit is consistent as it is (no rule broken); with one included and one reason too many, two rules are."""
    audit = sel.selection_audit(reasoned(spark, sf_dir))
    counts = sel.split_counts(split(spark, sf_dir))
    wrong = audit.withColumn("included", F.col("included") + 1).withColumn("target_messages", F.col("target_messages") + 1).withColumn("edited", F.col("edited") + 1)
    return sel.selection_violations(audit, counts).union(sel.selection_violations(wrong, counts))


@query("WITH p AS (SELECT CAST(user_id AS VARCHAR) AS person, CASE WHEN user_id % 10 = 3 THEN '' WHEN user_id % 10 = 4 THEN 'same' ELSE 'p' || user_id END AS name FROM (SELECT DISTINCT user_id FROM events)) SELECT person, 'target has a pseudonym' AS rule FROM p WHERE person = '7' UNION ALL SELECT person, 'no name' FROM p WHERE name = '' UNION ALL SELECT person, 'name is not unique' FROM p WHERE name <> '' AND name IN (SELECT name FROM p GROUP BY name HAVING count(*) > 1)")
def validate_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    name = F.when(u % 10 == 3, "").when(u % 10 == 4, "same").otherwise(F.concat(F.lit("p"), u))
    names = table(spark, sf_dir, "events").select("user_id").distinct().select(u.cast("string").alias("person"), name.alias("pseudonym"))
    return sel.pseudonym_violations(names, F.lit(TARGET))


@query(f"WITH {M} SELECT count(*) AS n FROM msg WHERE NOT coalesce(edited_at >= TIMESTAMP '2024-01-15', false) AND (deleted_at IS NULL OR deleted_at < TIMESTAMP '2024-01-15') AND sent_at < TIMESTAMP '2024-01-15'")
def availability_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return messages(spark, sf_dir).where(sel.available_before(at, F.col("sent_at"), F.col("edited_at"), F.col("deleted_at"))).agg(F.count("*").alias("n"))


PEOPLE = f"WITH {M}, p AS (SELECT author AS person, arg_max(CASE WHEN event_type = 'view' THEN 'n' || id END, (sent_at, id)) FILTER (WHERE event_type = 'view') AS name, count(*) AS messages, min(sent_at) AS first_at, max(sent_at) AS last_at, bool_or(author = {TARGET}) AS is_self FROM msg GROUP BY author)"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("n"), F.col("id")))
    return sel.people_summary(messages(spark, sf_dir), "author", name, "sent_at", "id", F.col("author") == TARGET)


@query(f"{PEOPLE} SELECT * FROM p")
def people_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir)


@query(f"{PEOPLE} SELECT person FROM p WHERE is_self")
def self_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.self_identity(people(spark, sf_dir))


@query(f"WITH {SPLIT} SELECT id, split, index FROM sp")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).select("id", "split", "index")


@query(f"WITH {SPLIT} SELECT s.split, count(sp.id) AS n FROM (VALUES ('train'), ('valid'), ('test')) s(split) LEFT JOIN sp ON sp.split = s.split GROUP BY s.split")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.split_counts(split(spark, sf_dir))


@query(f"WITH {SPLIT} SELECT s.split, bound.b_at AS bound_at, bound.b_id AS bound_id FROM (VALUES ('train'), ('valid'), ('test')) s(split) LEFT JOIN bound ON bound.split = s.split")
def purge_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.purge_bounds(split(spark, sf_dir), "sent_at", "id")


@query(f"WITH {M} SELECT id, chat, row_number() OVER (PARTITION BY chat ORDER BY sent_at, id) - 1 AS index FROM msg")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from 0 in each chat, by one global rank and each chat's first."""
    from parlance.plans.ordering import global_rank

    ranked = materialized(global_rank(messages(spark, sf_dir).select("id", "chat", "sent_at"), [F.col("chat"), F.col("sent_at"), F.col("id")], "rk"))
    first = ranked.groupBy("chat").agg(F.min("rk").alias("first"))
    return ranked.join(first, "chat").select("id", "chat", (F.col("rk") - F.col("first")).alias("index"))


@query("SELECT person, 'person_' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS pseudonym FROM (SELECT person, row_number() OVER (ORDER BY person) AS n FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS person FROM events WHERE user_id <> 7))")
def pseudonym_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.pseudonyms(sel.all_people(messages(spark, sf_dir), "author"), F.lit(TARGET))


@query("SELECT DISTINCT person FROM (SELECT user_id AS person FROM events UNION ALL SELECT user_id % 7 + 1000 FROM events)")
def set_people_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("mentioned", F.array(F.col("author") % 7 + 1000))
    return sel.all_people(m, "author", "mentioned")


@query("WITH m AS (SELECT event_id AS id, event_id % 3 AS chat, user_id AS author, ts, CASE WHEN event_id >= 5 THEN event_id - 5 END AS reply_to FROM events) SELECT m.id, 'reply target' AS rule FROM m JOIN m g ON g.id = m.reply_to WHERE g.chat <> m.chat OR g.ts >= m.ts UNION ALL SELECT id, 'edit before send' FROM m WHERE id % 100 = 0")
def validate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    none = F.lit(None)
    m = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("chat"), F.col("ts").alias("sent_at"), F.when(F.col("event_id") % 100 == 0, F.col("ts") - F.expr("INTERVAL 1 SECOND")).alias("edited_at"), none.cast("timestamp_ntz").alias("deleted_at"), F.when(F.col("event_id") >= 5, F.col("event_id") - 5).alias("reply_to"), F.col("user_id").alias("author"), none.cast("long").alias("quote_author"), none.cast("timestamp_ntz").alias("quote_sent_at"))
    r = e.where("event_type = 'signup'").select("event_id", F.col("event_id").alias("message_id"), (F.col("event_id") % 3).alias("chat"), F.col("ts").alias("sent_at"))
    return sel.message_violations(m, r)


@query(f"WITH {CONTEXT} SELECT target_id, event_id FROM cr")
def join_reaction_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = context(spark, sf_dir)
    return cx.context_reactions(c, reactions(spark, sf_dir), t).select("target_id", "event_id")


@query(f"WITH {CONTEXT}, both_ AS (SELECT target_id, sent_at, 0 AS kind, CAST(id AS VARCHAR) AS item FROM ctx UNION ALL SELECT target_id, r_at, 1, CAST(event_id AS VARCHAR) FROM cr) SELECT target_id, kind, item, row_number() OVER (PARTITION BY target_id ORDER BY sent_at, kind, item) AS nth FROM both_")
def timeline_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = context(spark, sf_dir)
    return cx.timeline(c, cx.context_reactions(c, reactions(spark, sf_dir), t)).select("target_id", "kind", "item", "nth")


@query(f"WITH {CONTEXT} SELECT count(*) AS n FROM (SELECT s FROM (SELECT split, target_id AS s FROM ctx UNION SELECT split, id FROM ctx) GROUP BY s HAVING count(DISTINCT split) > 1)")
def set_split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crossing(spark, sf_dir).agg(F.count("*").alias("n"))


def _crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = context(spark, sf_dir)
    lists = c.groupBy("target_id").agg(F.collect_list("id").alias("context"))
    return cx.disjoint_violations(t.join(lists, "target_id").select("split", "target_id", "context"))


@query(f"WITH {CONTEXT}, o AS (SELECT id, split, sent_at, lag((sent_at, id)) OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END, index) AS prev FROM sp) SELECT (SELECT count(*) FROM o WHERE prev >= (sent_at, id)) AS disorder, (SELECT count(*) FROM ctx WHERE id = target_id) AS own, (SELECT count(*) FROM (SELECT target_id, id FROM ctx GROUP BY ALL HAVING count(*) > 1)) AS repeated")
def validate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of index rows out of order, targets in their own context, and repeated context rows."""
    c, t = context(spark, sf_dir)
    # in order: within and between splits, the largest key of what comes before is smaller
    keyed = t.select("split", "index", F.struct("at", "target_id").alias("k"))
    after = keyed.select("split", (F.col("index") + 1).alias("index"), F.col("k").alias("prev"))
    inside = keyed.join(after, ["split", "index"]).where("prev >= k").agg(F.count("*").alias("a"))
    ends = keyed.groupBy("split").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    later = ends.select(F.col("split").alias("s2"), F.col("lo").alias("lo2"))
    pairs = ends.join(later, ((F.col("split") == "train") & (F.col("s2") != "train")) | ((F.col("split") == "valid") & (F.col("s2") == "test"))).where("hi >= lo2").agg(F.count("*").alias("b"))
    own = c.where("id = target_id").agg(F.count("*").alias("own"))
    twice = c.groupBy("target_id", "id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated"))
    return inside.crossJoin(pairs).crossJoin(own).crossJoin(twice).select((F.col("a") + F.col("b")).alias("disorder"), "own", "repeated")


@query("SELECT p_partkey AS id, nullif(replace(replace(replace(trim(regexp_replace(regexp_replace('@@ ' || p_name || ' [x|' || p_partkey || '] ', '^@+', ''), ' +', ' ', 'g')), '[', '('), ']', ')'), '|', '/'), '') AS name FROM part")
def normalize_person_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("@@ "), F.col("p_name"), F.lit(" [x|"), F.col("p_partkey"), F.lit("] "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rd.person_name(raw).alias("name"))


@query("SELECT m.event_id AS id, coalesce(p.name, 'target') AS name FROM (SELECT event_id, user_id FROM events) m LEFT JOIN (SELECT person, 'person_' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS name FROM (SELECT person, row_number() OVER (ORDER BY person) AS n FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS person FROM events WHERE user_id <> 7))) p ON p.person = CAST(m.user_id AS VARCHAR)")
def join_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    names = sel.pseudonyms(sel.all_people(m, "author"), F.lit(TARGET))
    joined = m.join(names, F.col("author").cast("string") == F.col("person"), "left")
    missing = F.raise_error(F.lit("a person has no pseudonym")).cast("string")
    return joined.select("id", F.when(F.col("author") == TARGET, "target").otherwise(F.coalesce("pseudonym", missing)).alias("name"))


@query("SELECT m.event_id AS id, g.user_id AS original_author FROM (SELECT *, event_id - 5 AS reply_to FROM events) m LEFT JOIN events g ON g.event_id = m.reply_to")
def join_reply_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    goal = m.select((F.col("id") + 5).alias("id"), F.col("author").alias("original_author"))
    return m.select("id").join(goal, "id", "left")


MENTIONED = "length(text) >= 7"


@query(f"SELECT doc_id, sha256(CASE WHEN {MENTIONED} THEN CASE WHEN substr(text, 4, 1) = '@' AND substr(text, 5, 1) <> '@' THEN left(text, 3) ELSE left(text, 4) END || '@Bob' || substr(text, 8) ELSE text END) AS digest FROM documents")
def render_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters 5 to 7 of every text that has them are a mention, addressed in UTF-16 units."""
    start, length = units(F.substring("text", 1, 4)), units(F.substring("text", 5, 3))
    one = F.array(F.struct(start.alias("start"), length.alias("length"), F.lit("Bob").alias("name")))
    found = F.when(F.expr(MENTIONED), one)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(rd.render_mentions(F.col("text"), found), 256).alias("digest"))


@query("SELECT doc_id, doc_id % 5 < 3 AND (doc_id % 40) + doc_id % 5 <= length(text) AND doc_id % 5 > 0 AS ok FROM documents")
def validate_mention_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range is fine if it has a length, lies in the text and does not overlap the next, which starts two units later."""
    from parlance.operators.parsing import mention_error

    d = table(spark, sf_dir, "documents").withColumn("start", (F.col("doc_id") % 40).cast("int")).withColumn("n", (F.col("doc_id") % 5).cast("int"))
    m = lambda s, n: F.struct(F.lit("x").alias("person_id"), s.alias("start"), n.alias("length"), F.lit(None).cast("string").alias("name"))
    both = F.array(m(F.col("start"), F.col("n")), m(F.col("start") + 2, F.col("n")))
    found = F.when(F.col("start") + 2 + F.col("n") <= F.length("text"), both).otherwise(F.array(m(F.col("start"), F.col("n"))))
    ok = mention_error(F.col("text"), found).isNull() & (F.col("n") < 3)
    return d.select("doc_id", ok.alias("ok"))


@query("SELECT doc_id, 'A' || CASE WHEN doc_id % 2 = 0 THEN ' | mentions @T' ELSE '' END || CASE WHEN doc_id % 3 = 1 THEN ' | 1 attachment' WHEN doc_id % 3 = 2 THEN ' | 2 attachments' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' | reply to an earlier message' ELSE '' END AS header FROM documents")
def message_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    reply = rd.reply_text(i % 5 == 0, F.lit(None).cast("string"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", rd.message_header(F.lit("A"), F.lit("T"), i % 2 == 0, i % 3, F.lit(True), reply).alias("header"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN '[deleted message]' WHEN doc_id % 4 = 1 THEN text WHEN doc_id % 4 = 2 THEN '[attachment]' ELSE '[empty message]' END) AS digest FROM documents")
def message_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 4
    body = rd.message_body(F.when(i == 0, F.lit(1)), F.when(i == 1, F.col("text")), F.when(i == 2, 1).otherwise(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(body, 256).alias("digest"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN 'A removed ' || to_json(text) || ' reaction from B''s message' ELSE 'A reacted ' || to_json(text) || ' to an earlier message' END) AS digest FROM documents")
def reaction_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    line = rd.reaction_line(F.lit("A"), F.col("text"), even, F.when(even, "B"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(line, 256).alias("digest"))


@query("SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN 'reply to Ann: ' || to_json(text) WHEN 1 THEN 'reply to an earlier message' END) AS digest FROM documents")
def reply_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 3
    reply = rd.reply_text(i < 2, F.when(i == 0, "Ann"), F.when(i == 0, F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(reply, 256).alias("digest"))


CHAT_LINES = "string_agg(chr(10) || '[' || role || ']' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn)"


@query(f"SELECT conv_id, sha256('You are T. Write only T''s next message.' || chr(10) || chr(10) || 'Conversation:' || chr(10) || {CHAT_LINES} || chr(10) || chr(10) || '[next response]') AS digest FROM conversations GROUP BY conv_id")
def render_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    e = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("header"), F.coalesce("text", F.lit("")).alias("content")))).alias("e"))
    return e.select("conv_id", F.sha2(rd.conversation(F.lit("T"), F.col("e")), 256).alias("digest"))


@query("SELECT doc_id, 3 AS n_turns, sha256('<' || text || '>') AS prompt, 'Re: ' AS prefill FROM documents")
def format_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", rd.format_turns(F.col("text"), prefix="<", suffix=">", system="Be brief.", prefill="Re: ").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_turns"), F.sha2(F.col("t")[1]["content"], 256).alias("prompt"), F.col("t")[2]["content"].alias("prefill"))


@query("SELECT doc_id, sha256('{\"messages\":[{\"role\":\"system\",\"content\":\"Be brief.\"},{\"role\":\"user\",\"content\":' || to_json('<' || lang || '>') || '},{\"role\":\"assistant\",\"content\":' || to_json('Re: ' || text || '!') || '}]}') AS digest FROM documents")
def format_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training row: the prompt between its marks, the completion after the prefill and before the ending."""
    row = rd.example_row(F.col("lang"), F.col("text"), prefix="<", suffix=">", system="Be brief.", prefill="Re: ", ending="!")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(row, 256).alias("digest"))


@query("SELECT event_id, sha256('{\"at\":' || (epoch_us(ts) // 1000) || ',\"id\":' || event_id || ',\"text\":' || to_json(props) || ',\"type\":' || to_json(event_type) || '}') AS digest FROM events")
def canonical_json_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = canonical_object({"type": value(F.col("event_type"), "string"), "id": value(F.col("event_id"), "number"), "text": value(F.col("props"), "string"), "at": value(F.unix_millis(F.col("ts").cast("timestamp")), "number")})
    return table(spark, sf_dir, "events").select("event_id", F.sha2(body, 256).alias("digest"))


@query("WITH k AS (SELECT event_id AS i, event_id // 1000 AS b, sha256('{\"id\":' || event_id || ',\"text\":' || to_json(props) || '}') AS d FROM events), bl AS (SELECT b, sha256(string_agg(d, chr(10) ORDER BY i)) AS d FROM k GROUP BY b), top AS (SELECT b // 1000 AS b, sha256(string_agg(d, chr(10) ORDER BY b)) AS d  FROM bl GROUP BY b // 1000) SELECT CASE WHEN (SELECT max(b) FROM bl) = 0 THEN (SELECT d FROM bl WHERE b = 0) ELSE (SELECT d FROM top WHERE b = 0) END AS digest")
def source_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = canonical_object({"id": value(F.col("event_id"), "number"), "text": value(F.col("props"), "string")})
    found = artifacts.rows_digest(table(spark, sf_dir, "events").withColumn("body", body), "body", "event_id")
    return spark.range(1).select(F.lit(found).alias("digest"))


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current messages and reactions of the parsed envelopes."""
    from parlance.operators import revisions as rv
    from parlance.queries.ingest import parsed

    # parsed once for both
    rows = materialized(parsed(spark, sf_dir).drop("payload"))
    return materialized(rv.current_messages(rows, "seq")), rv.current_reactions(rows)


def recipe(messages: DataFrame) -> ds.Recipe:
    """The person with the most messages that can be targets, the first of them by id."""
    most = messages.where("text IS NOT NULL AND edited_at IS NULL").groupBy("author_id").agg(F.count_if(F.size("attachments") == 0).alias("n")).orderBy(F.desc("n"), "author_id").first()
    return ds.Recipe(target=most["author_id"], target_name="Target", context=K, valid=VALID, test=TEST)


@query()
def render_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts and completions of one person's replies; clicks lose their attachments so that some are targets."""
    m, r = corpus(spark, sf_dir)
    m = m.withColumn("attachments", F.when(F.col("seq") % 2 == 0, F.col("attachments")).otherwise(F.slice("attachments", 1, 0)))
    return ds.examples(m, r, recipe(m)).select("split", "index", "target_message_id", "prompt", "completion")


@query()
def build_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build, build again and verify: one id, and the rows of each part."""
    m, r = corpus(spark, sf_dir)
    m = m.withColumn("attachments", F.when(F.col("seq") % 2 == 0, F.col("attachments")).otherwise(F.slice("attachments", 1, 0)))
    root = fresh_path(spark, "data")
    one, two = (ds.build(spark, m, r, recipe(m), root) for _ in range(2))
    manifest = artifacts.verify_artifact(spark, f"{root}/{one}")
    rows = [(name, f["rows"], one == two) for name, f in sorted(manifest["files"].items())]
    return spark.createDataFrame(rows, "part string, n long, same_id boolean")
