"""Transcripts over ``conversations``, lineage and registry over ``part``, ``orders`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import evaluation as ev
from parlance.operators import transcripts as tr
from parlance.queries.registry import query, table

TURNS = "t AS (SELECT conv_id AS chat, turn, role, text FROM conversations)"
TALK = "t AS (SELECT conv_id AS chat, turn, role, text FROM conversations WHERE role IN ('user', 'assistant'))"


def turns(spark: SparkSession, sf_dir: str, talk: bool = False) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat"), "turn", "role", "text")
    return t.where(F.col("role").isin("user", "assistant")) if talk else t


@query(f"WITH {TURNS}, l AS (SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY chat ORDER BY turn)) SELECT chat, turn, 'role' AS rule FROM l WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT chat, turn, 'start' FROM l WHERE n = 1 AND role <> 'user' UNION ALL SELECT chat, turn, 'alternation' FROM l WHERE role = prev")
def validate_turn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.turn_order_violations(turns(spark, sf_dir))


@query(f"WITH {TALK}, u AS (SELECT chat, turn, row_number() OVER (PARTITION BY chat ORDER BY turn DESC) AS nth, sum(length(text)) OVER (PARTITION BY chat ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM t) SELECT chat, turn, CAST(used AS BIGINT) AS used, nth <= 4 AND used <= 1500 AS kept FROM u")
def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.context_fit(turns(spark, sf_dir, True), 4, 1500, F.length("text")).select("chat", "turn", "used", "kept")


@query(f"WITH {TURNS} SELECT chat, sha256('[' || string_agg('{{\"content\":' || to_json(text) || ',\"role\":' || to_json(role) || '}}', ',' ORDER BY turn) || ']') AS digest FROM t GROUP BY chat")
def transcript_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.transcript_digest(turns(spark, sf_dir))


@query(f"WITH {TALK}, m AS (SELECT chat, max(turn) AS last, arg_max(role, turn) AS r FROM t GROUP BY chat) SELECT t.chat, t.turn, CASE WHEN r = 'assistant' THEN 1 ELSE 0 END AS attempt FROM t JOIN m USING (chat) WHERE NOT (t.turn = last AND r = 'assistant')")
def retry_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.retry(turns(spark, sf_dir, True)).select("chat", "turn", "attempt")


@query(f"WITH {TURNS} SELECT chat, turn, CAST('0x' || substr(sha256('9:' || sha256(text) || ':' || turn), 9, 8) AS BIGINT) & 2147483647 AS seed FROM t")
def chat_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("chat", "turn", ev.chat_seed(F.lit(9), F.sha2("text", 256), F.col("turn")).alias("seed"))


LINEAGE = "n AS (SELECT p_partkey AS id, CASE WHEN p_partkey <= 1 THEN NULL ELSE CAST(floor((p_partkey - 1) / 3.0) AS BIGINT) END AS parent, p_name AS title FROM part)"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.when(k > 1, F.floor((k - 1) / 3)).cast("long").alias("parent"), F.col("p_name").alias("title"))


@query(f"WITH {LINEAGE} SELECT id FROM n WHERE id NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL)")
def anti_lineage_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.leaves(snapshots(spark, sf_dir)).select("id")


@query(f"WITH {LINEAGE} SELECT id, parent FROM n WHERE id <> (SELECT max(id) FROM n)")
def lineage_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    last = s.agg(F.max("id")).first()[0]
    return tr.without_leaf(s, F.lit(last)).select("id", "parent")


@query(f"WITH {LINEAGE} SELECT id, CASE WHEN id = (SELECT max(id) FROM n) THEN 'renamed' ELSE title END AS title FROM n")
def lineage_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    last = s.agg(F.max("id")).first()[0]
    return tr.renamed_leaf(s, F.lit(last), "renamed").select("id", "title")


@query(f"WITH {LINEAGE} SELECT id, row_number() OVER (ORDER BY title DESC, id DESC) AS place FROM n WHERE id NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL)")
def registry_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.plans.ordering import global_rank

    return global_rank(tr.leaves(snapshots(spark, sf_dir)).select("id", "title"), [F.desc("title"), F.desc("id")], "place").select("id", "place")


@query("SELECT user_id, round(sum(event_id % 90 * value) FILTER (WHERE event_type <> 'view') / nullif(sum(event_id % 90) FILTER (WHERE event_type <> 'view'), 0), 6) AS throughput FROM events GROUP BY user_id")
def weighted_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 90).alias("tokens"), F.when(F.col("event_type") != "view", F.col("value")).alias("rate"))
    return tr.weighted_throughput(e, "user_id").withColumn("throughput", F.round("throughput", 6))


@query("SELECT user_id AS chat, event_id AS turn, 'rate' AS field FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id, 'tokens' FROM events WHERE event_id % 50 = 0")
def telemetry_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    odd = F.when(i % 3 == 0, float("nan")).when(i % 3 == 1, float("inf")).otherwise(-1.0)
    t = e.select(F.col("user_id").alias("chat"), i.alias("turn"), F.when(i % 50 != 0, i).alias("tokens"), F.when(F.col("event_type") == "view", odd).otherwise(F.abs("value")).alias("rate"))
    return tr.telemetry_violations(t, ("tokens",), ("rate",))


@query("SELECT doc_id, 100.0 * n_chars / 4096 AS pressure FROM documents")
def context_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tr.context_pressure(F.col("n_chars"), 4096).alias("pressure"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 3)) AS shared FROM orders")
def prefix_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("id"))
    return tr.prefix_collisions(o, "id", 3).select("o_orderkey", "shared")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("dataset_id"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"))
    return tr.runs_with_datasets(r, known)


RUNS = "r AS (SELECT o_orderkey AS run, CASE WHEN c.c_custkey IS NULL THEN 'dataset not found' END AS error FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_custkey % 5 <> 0)"


@query(f"WITH {RUNS} SELECT * FROM r")
def join_run_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run", "error")


@query(f"WITH {RUNS} SELECT n_name AS name, 'BASE' AS type, 'READY' AS entry FROM nation UNION ALL SELECT CAST(run AS VARCHAR), CASE WHEN error IS NULL THEN 'CONSTRUCT' ELSE '—' END, CASE WHEN error IS NULL THEN 'READY' ELSE 'FAULT' END FROM r UNION ALL SELECT CAST(conv_id AS VARCHAR), 'TRACE', 'READY' FROM (SELECT DISTINCT conv_id FROM conversations)")
def registry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("name")).distinct()
    return tr.registry(base, runs(spark, sf_dir).select(F.col("run").cast("string").alias("name"), "error"), chats)


ONE_LINE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN {ONE_LINE} = '' THEN 'Chat' WHEN length({ONE_LINE}) <= 48 THEN {ONE_LINE} ELSE rtrim(substr({ONE_LINE}, 1, 47)) || '…' END "
    "WHEN 2 * k + length(source) <= 64 THEN repeat('名', k) || source ELSE repeat('名', least(k, 31)) || left(source, greatest(0, 63 - 2 * k)) || '…' END AS title "
    "FROM (SELECT *, CAST(doc_id % 50 AS INTEGER) AS k FROM documents)"
)
def title_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chat has a title of its own, of wide characters before its source."""
    wide = F.concat(F.repeat(F.lit("名"), (F.col("doc_id") % 50).cast("int")), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.title(F.when(F.col("doc_id") % 3 == 0, wide), F.col("text")).alias("title"))


@query("SELECT p_partkey, upper(p_name) || '@' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) || ' [m' || p_partkey || ']' AS name FROM part")
def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("hub\\org/m"), F.col("p_partkey"), F.lit("//"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.canonical_name(F.col("p_name"), F.sha2(F.col("p_partkey").cast("string"), 256), path).alias("name"))


@query("SELECT 'm' || p_partkey AS name, p_partkey FROM part")
def model_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/a/b/m"), F.col("p_partkey"), F.lit("/"))
    return table(spark, sf_dir, "part").select(tx.basename(path).alias("name"), "p_partkey")


@query("SELECT 'size' AS name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT 'what brand', p_brand FROM part UNION ALL SELECT 'what kind type', p_type FROM part")
def flatten_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.struct(F.col("p_type").alias("type"))
    return tr.flatten_fields(table(spark, sf_dir, "part").select(F.struct(kind.alias("kind"), F.col("p_brand").alias("brand")).alias("what"), F.col("p_size").alias("size")))


@query("SELECT p_partkey, '{\"cache\":' || CASE WHEN p_partkey % 2 = 0 THEN to_json('/m/' || p_name) ELSE 'null' END || ',\"sizes\":[' || p_size || ',' || p_size + 1 || '],\"type\":' || to_json(p_type) || '}' AS policy FROM part")
def policy_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as canonical JSON without what only says which of them were given."""
    k = F.col("p_partkey")
    cache = F.when(k % 2 == 0, F.concat(F.lit("/m/"), F.col("p_name")))
    row = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_type").alias("type"), F.array("p_size", F.col("p_size") + 1).alias("sizes"), cache.alias("cache"), F.array(F.lit("type")).alias("specified")).alias("c"))
    return row.select("p_partkey", tr.normalized_policy(F.col("c"), row.schema["c"].dataType).alias("policy"))


COMMANDS = ["/cold", "/coat", "/small", "/smooth", "/red"]


@query(f"SELECT p_partkey, typed, command FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN '/' ELSE '' END || left(p_name, CAST(1 + p_partkey % 6 AS INTEGER)) AS typed FROM part), (VALUES {', '.join(f"('{c}')" for c in COMMANDS)}) c(command) WHERE typed LIKE '/%' AND typed NOT LIKE '% %' AND starts_with(command, typed)")
def command_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    typed = F.concat(F.when(k % 5 > 0, "/").otherwise(""), F.substring(F.col("p_name"), F.lit(1), (1 + k % 6).cast("int")))
    return tr.command_matches(table(spark, sf_dir, "part").select("p_partkey", typed.alias("typed")), COMMANDS)


@query(f"WITH {TURNS} SELECT chat, bool_or(turn % 5 = 4) OR chat % 7 = 0 AS dirty FROM t GROUP BY chat")
def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats whose turns differ from what was saved: fifth turns have changed, every seventh chat was never saved."""
    t = turns(spark, sf_dir)
    saved = t.where("chat % 7 <> 0").withColumn("text", F.when(F.col("turn") % 5 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return tr.dirty(t, tr.transcript_digest(saved))
