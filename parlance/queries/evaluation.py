"""Evaluation over ``documents`` as predictions, ``benchmark`` as training texts, ``lineitem`` as scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import evaluation as ev
from parlance.operators import resampling as rs
from parlance.operators import matching as mt
from parlance.plans.durable import materialized
from parlance.plans.spread import split_scan
from parlance.queries.registry import query, table

THRESHOLD = 50
#: The comparison form, as far as DuckDB has it; the tables hold nothing that NFKC changes.
NORM = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
PRED = f"pred AS (SELECT doc_id AS cand_id, doc_id % 200 AS example_id, CAST(floor(doc_id / 200.0) AS BIGINT) AS seed, text, {NORM.format('text')} AS norm, CASE WHEN n_chars > 4000 THEN 'length' ELSE 'stop' END AS finish_reason, source AS run, n_chars FROM documents)"
TRAIN = f"train AS (SELECT item_id AS train_id, text, {NORM.format('text')} AS norm FROM benchmark)"
#: Windows of THRESHOLD characters that both sides have, and the runs they make.
MATCH = f"""
    {PRED}, {TRAIN},
    tw AS (SELECT DISTINCT substr(norm, i, {THRESHOLD}) AS w FROM (SELECT norm, unnest(range(1, greatest(length(norm) - {THRESHOLD} + 2, 1))) AS i FROM train)),
    pw AS (SELECT cand_id, norm, unnest(range(1, greatest(length(norm) - {THRESHOLD} + 2, 1))) AS i FROM pred),
    hit AS (SELECT DISTINCT cand_id FROM pw JOIN tw ON tw.w = substr(pw.norm, pw.i, {THRESHOLD}))
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("cand_id"), (F.col("doc_id") % 200).alias("example_id"), F.floor(F.col("doc_id") / 200).alias("seed"), "text", tx.normalize_text(F.col("text")).alias("norm"), F.when(F.col("n_chars") > 4000, "length").otherwise("stop").alias("finish_reason"), F.col("source").alias("run"), "n_chars")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("train_id"), "text", tx.normalize_text(F.col("text")).alias("norm"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("example_id"), F.col("l_linenumber").alias("run"))
    return lines.agg(F.sum("l_quantity").alias("tokens"), (F.sum("l_extendedprice") / 1000.0).alias("nll"))


SCORES = "s AS (SELECT l_orderkey AS example_id, l_linenumber AS run, sum(l_quantity) AS tokens, sum(l_extendedprice) / 1000.0 AS nll FROM lineitem GROUP BY ALL)"
DELTAS = f"{SCORES}, d AS (SELECT s.example_id, s.run, s.nll / s.tokens - b.nll / b.tokens AS delta FROM s JOIN s b ON b.example_id = s.example_id AND b.run = 1 WHERE s.run <> 1), pd AS (SELECT example_id, avg(delta) AS delta FROM d GROUP BY example_id)"


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.paired_deltas(scores(spark, sf_dir), F.lit(1))


#: Moves exact halves to one side, which sums in another order would leave to chance.
OFF = 1.0000000001


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(f"WITH {PRED} SELECT cand_id, sha256(norm) AS digest FROM pred")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("cand_id", F.sha2("norm", 256).alias("digest"))


@query(f"WITH {TRAIN} SELECT train_id, i - 1 AS pos, substr(norm, i, 16) AS w FROM (SELECT train_id, norm, unnest(range(1, greatest(length(norm) - 14, 1), 35)) AS i FROM train WHERE length(norm) >= {THRESHOLD})")
def rolling_hash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled seeds of the training texts, as text."""
    t = training(spark, sf_dir).where(F.length("norm") >= THRESHOLD)
    w = F.flatten(tx.windows(F.col("norm"), 16))
    return t.select("train_id", F.posexplode(w).alias("pos", "w")).where(F.col("pos") % (THRESHOLD - 15) == 0).select("train_id", F.col("pos").cast("long").alias("pos"), "w")


@query(f"WITH {PRED}, {TRAIN}, sw AS (SELECT DISTINCT train_id, substr(norm, i, 16) AS w FROM (SELECT train_id, norm, unnest(range(1, greatest(length(norm) - 14, 1), 35)) AS i FROM train WHERE length(norm) >= {THRESHOLD})), pw AS (SELECT cand_id, norm, unnest(range(1, greatest(length(norm) - 14, 1))) AS i FROM pred WHERE length(norm) >= {THRESHOLD}) SELECT DISTINCT cand_id, train_id FROM pw JOIN sw ON sw.w = substr(pw.norm, pw.i, 16)")
def join_seed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.seed_pairs(predictions(spark, sf_dir).select("cand_id", "norm"), training(spark, sf_dir).select("train_id", "norm"), THRESHOLD)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.longest_matches(predictions(spark, sf_dir).select("cand_id", "norm"), training(spark, sf_dir).select("train_id", "norm"), THRESHOLD)


@query(f"WITH {MATCH} SELECT cand_id FROM hit")
def training_match_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).where(F.col("longest") >= THRESHOLD).select("cand_id")


LONGEST = f"""
    WITH {MATCH}, tp AS (SELECT train_id, i AS ti, substr(norm, i, {THRESHOLD}) AS w FROM (SELECT train_id, norm, unnest(range(1, greatest(length(norm) - {THRESHOLD} + 2, 1))) AS i FROM train)),
    dg AS (SELECT pw.cand_id, tp.train_id, pw.i, pw.i - tp.ti AS diag FROM pw JOIN tp ON tp.w = substr(pw.norm, pw.i, {THRESHOLD})),
    rn AS (SELECT *, i - row_number() OVER (PARTITION BY cand_id, train_id, diag ORDER BY i) AS g FROM dg),
    ln AS (SELECT cand_id, max(n) + {THRESHOLD} - 1 AS longest FROM (SELECT cand_id, count(*) AS n FROM rn GROUP BY cand_id, train_id, diag, g) GROUP BY cand_id)
"""


@query(f"{LONGEST} SELECT p.cand_id, coalesce(ln.longest, 0) AS longest FROM pred p LEFT JOIN ln USING (cand_id)")
def longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir)


#: The largest source's texts stand for the training set where whole texts are looked for.
LEARNED = "run = 'src0'"


@query(f"WITH {PRED} SELECT p.cand_id FROM pred p WHERE norm <> '' AND norm IN (SELECT norm FROM pred WHERE {LEARNED})")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("cand_id", "norm", "run")
    return mt.exact_matches(p, p.where(LEARNED).select("norm"))


S = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
FEATURE_SQL = f"""
    SELECT doc_id, lang, CAST(length(t) AS DOUBLE) AS characters, CAST(CASE WHEN t = '' THEN 0 ELSE len(regexp_extract_all(t, '\\s+')) + 1 END AS DOUBLE) AS words,
           CAST(len(string_split(t, chr(10))) AS DOUBLE) AS lines,
           round(length(regexp_replace(t, '\\P{{P}}', '', 'g')) / greatest(length(t), 1), 9) AS punctuation_density,
           round(length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) / greatest(length(regexp_replace(t, '\\P{{L}}', '', 'g')), 1), 9) AS uppercase_ratio,
           CAST(regexp_matches(t, '@[\\pL\\pN_.-]+') AS DOUBLE) AS mention_rate, CAST(regexp_matches(t, '(?i)https?://|www\\.') AS DOUBLE) AS url_rate,
           CAST(contains(t, '?') AS DOUBLE) AS question_rate, CAST(contains(t, '!') AS DOUBLE) AS exclamation_rate,
           CAST(regexp_matches(t, '[\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]') AS DOUBLE) AS emoji_rate,
           CAST(len(list_filter(list_zip(c, c[2:], c[3:]), lambda x: x[1] = x[2] AND x[1] = x[3])) > 0 AS DOUBLE) AS repeated_character_rate,
           CAST(right(t, 1) IN ('.', '!', '?', '…') AS DOUBLE) AS terminal_punctuation_rate, CAST(regexp_matches(t, '^\\p{{Ll}}') AS DOUBLE) AS starts_lowercase_rate
    FROM (SELECT doc_id, lang, t, string_split(t, '') AS c FROM (SELECT doc_id, lang, {S} AS t FROM documents))
"""


@query(f"SELECT * EXCLUDE (lang) FROM ({FEATURE_SQL})")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tx.features(F.col("text"))
    ratios = ("punctuation_density", "uppercase_ratio")
    return split_scan(table(spark, sf_dir, "documents")).select("doc_id", *[(F.round(f[n], 9) if n in ratios else f[n]).alias(n) for n in tx.FEATURES])


MEANS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in tx.FEATURES)


@query(f"SELECT lang, {MEANS} FROM ({FEATURE_SQL}) GROUP BY lang")
def voice_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.profile(table(spark, sf_dir, "documents"), "text", "lang"), *tx.FEATURES)


@query(f"WITH f AS ({FEATURE_SQL}) SELECT " + ", ".join(f"round(abs(avg({n}) FILTER (WHERE lang = 'en') - avg({n}) FILTER (WHERE lang = 'fr')), 6) AS {n}" for n in tx.FEATURES) + " FROM f")
def voice_profile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    diff = ev.profile_difference(ev.profile(d.where("lang = 'en'"), "text"), ev.profile(d.where("lang = 'fr'"), "text"))
    return rounded(diff, *tx.FEATURES)


GRAMS = "SELECT substr(norm, i, 3) AS gram, count(*) AS n FROM (SELECT norm, unnest(range(1, greatest(length(norm) - 1, 1))) AS i FROM train) GROUP BY gram"


@query(f"WITH {TRAIN} {GRAMS}")
def char_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.ngram_counts(training(spark, sf_dir), "norm")


@query(f"WITH {TRAIN}, l AS (SELECT gram, n FROM ({GRAMS.replace('FROM train', 'FROM train WHERE train_id < (SELECT max(train_id) FROM train)')})), r AS ({GRAMS}), j AS (SELECT coalesce(l.n, 0) / (SELECT sum(n) FROM l) AS p, coalesce(r.n, 0) / (SELECT sum(n) FROM r) AS q FROM l FULL JOIN r USING (gram)) SELECT round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END), 9) AS jsd FROM j")
def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = training(spark, sf_dir)
    last = t.agg(F.max("train_id").alias("m"))
    some = t.crossJoin(F.broadcast(last)).where("train_id < m")
    return rounded(mt.js_divergence(mt.ngram_counts(some, "norm"), mt.ngram_counts(t, "norm")), "jsd", places=9)


ROLE_SQL = "(regexp_matches(text, '(?i)(^|\\n)\\s*(assistant|system|user)\\s*:') OR lower(text) LIKE '%<think>%' OR lower(text) LIKE '%</think>%' OR lower(text) LIKE '%[next response]%' OR lower(text) LIKE '%conversation:%')"


@query(f"SELECT conv_id, turn, {ROLE_SQL} AS bad FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || chr(10) || ' ' || upper(role) || ' : x' WHEN turn % 3 = 1 THEN text || '<Think>' ELSE text END AS text FROM conversations)")
def format_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("turn") % 3
    text = F.when(third == 0, F.concat("text", F.lit("\n "), F.upper("role"), F.lit(" : x"))).when(third == 1, F.concat("text", F.lit("<Think>"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.format_violation(text).alias("bad"))


@query("SELECT conv_id, turn, len(list_filter(regexp_extract_all(text || ' @' || role || ' and @eve.', '@[\\pL\\pN_.-]+'), lambda x: x NOT IN ('@user', '@eve.'))) > 0 AS unknown FROM conversations")
def unknown_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that mention someone beside the two whom their prompt knows: an assistant's or a system's role, or who stands in the text."""
    said = F.concat("text", F.lit(" @"), "role", F.lit(" and @eve."))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.unknown_mention(said, F.lit("@user: ask @eve.")).alias("unknown"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    known = p.where(LEARNED).select("norm")
    return ev.diagnostics(p.withColumn("prompt", F.lit("@ann")), matches(spark, sf_dir), mt.exact_matches(p, known), THRESHOLD)


FLAGS = f"{MATCH}, fl AS (SELECT p.cand_id, run, {S} = '' AS empty, {ROLE_SQL} AS format_violation, len(list_filter(regexp_extract_all(text, '@[\\pL\\pN_.-]+'), lambda x: x <> '@ann')) > 0 AS unknown_mention, finish_reason = 'length' AS truncated, hit.cand_id IS NOT NULL AS long_training_match, norm <> '' AND norm IN (SELECT norm FROM pred WHERE {LEARNED}) AS exact_training_match FROM pred p LEFT JOIN hit USING (cand_id))"


@query(f"WITH {FLAGS} SELECT cand_id, empty, format_violation, unknown_mention, truncated, long_training_match, exact_training_match FROM fl")
def prediction_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).select("cand_id", "empty", "format_violation", "unknown_mention", "truncated", "long_training_match", "exact_training_match")


RATES = {"empty": "empty_rate", "format_violation": "format_violation_rate", "unknown_mention": "unknown_mention_rate", "truncated": "truncation_rate", "long_training_match": "long_training_match_rate", "exact_training_match": "exact_training_match_rate"}


@query(f"WITH {FLAGS} SELECT run, " + ", ".join(f"round(avg(CAST({k} AS INT)), 9) AS {v}" for k, v in RATES.items()) + " FROM fl GROUP BY run")
def behavior_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.behavior_rates(flags(spark, sf_dir), "run"), *RATES.values(), places=9)


@query(f"WITH {MATCH} SELECT round((SELECT count(*) FROM hit) / count(*), 9) AS rate FROM pred")
def memorization_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).agg(F.round(F.avg((F.col("longest") >= THRESHOLD).cast("int")), 9).alias("rate"))


@query("SELECT event_id, greatest(0.0, value / 100 - greatest(event_id % 10 / 10.0, event_id % 7 / 10.0)) AS delta FROM events")
def incremental_memorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", ev.incremental_memorization(F.col("value") / 100, i % 10 / 10.0, i % 7 / 10.0).alias("delta"))


@query(f"WITH {PRED} SELECT round((count(*) - count(DISTINCT norm)) / count(*), 9) AS rate FROM pred WHERE norm <> ''")
def cross_prompt_duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.cross_prompt_duplicates(predictions(spark, sf_dir), "norm"), "rate", places=9)


@query(f"WITH {PRED} SELECT round(avg(CAST(n > d AS INT)), 9) AS rate FROM (SELECT example_id, count(*) AS n, count(DISTINCT norm) AS d FROM pred GROUP BY example_id)")
def within_prompt_duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.within_prompt_duplicates(predictions(spark, sf_dir), "norm", "example_id"), "rate", places=9)


@query(f"WITH {PRED}, v AS (SELECT avg(CAST({S} = '' AS INT)) AS empty_rate, avg(CAST(finish_reason = 'length' AS INT)) AS truncation_rate FROM pred), g AS (SELECT 'empty_rate' AS gate, empty_rate AS value, 0.02 AS lim FROM v UNION ALL SELECT 'truncation_rate', truncation_rate, 0.03 FROM v) SELECT gate, round(value, 9) AS value, CAST(lim AS DOUBLE) AS \"limit\", value <= lim AS passed, (SELECT bool_and(value <= lim) FROM g) AS eligible FROM g")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select((tx.strip(F.col("text")) == "").cast("int").alias("e"), (F.col("finish_reason") == "length").cast("int").alias("t"))
    return rounded(ev.gates(p.agg(F.avg("e").alias("empty_rate"), F.avg("t").alias("truncation_rate")), {"empty_rate": 0.02, "truncation_rate": 0.03}), "value", places=9)


LIKE = "round(avg(nll / tokens), 6) AS macro_mean_nll, round(sum(nll) / sum(tokens), 6) AS corpus_mean_nll, round(exp(least(sum(nll) / sum(tokens), 700)), 6) AS corpus_perplexity"
MEASURES = ("macro_mean_nll", "corpus_mean_nll", "corpus_perplexity")


@query(f"WITH {SCORES} SELECT run, {LIKE} FROM s GROUP BY run")
def corpus_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.likelihood(scores(spark, sf_dir), "run"), *MEASURES)


@query(f"WITH {SCORES} SELECT round(avg(nll / tokens), 6) AS macro_mean_nll FROM s")
def macro_mean_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.likelihood(scores(spark, sf_dir)), *MEASURES).select("macro_mean_nll")


@query(f"WITH {SCORES} SELECT round(sum(nll) / sum(tokens), 6) AS corpus_mean_nll FROM s")
def corpus_mean_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.likelihood(scores(spark, sf_dir)), *MEASURES).select("corpus_mean_nll")


@query(f"WITH {SCORES} SELECT round(avg(m), 6) AS macro, (SELECT round(sum(nll) / sum(tokens), 6) FROM s WHERE run <> 1) AS corpus FROM (SELECT example_id, avg(nll / tokens) AS m FROM s WHERE run <> 1 GROUP BY example_id)")
def policy_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).where("run <> 1")
    per = s.groupBy("example_id").agg(F.avg(F.col("nll") / F.col("tokens")).alias("m"), F.sum("nll").alias("n"), F.sum("tokens").alias("t"))
    return per.agg(F.round(F.avg("m"), 6).alias("macro"), F.round(F.sum("n") / F.sum("t"), 6).alias("corpus"))


@query(f"WITH {DELTAS} SELECT example_id, run, round(delta * {OFF}, 6) AS delta FROM d")
def join_scores_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas(spark, sf_dir).withColumn("delta", F.round(F.col("delta") * OFF, 6))


@query(f"WITH {DELTAS} SELECT run, round(avg(CAST(delta < 0 AS INT)), 9) AS improved_rate FROM d GROUP BY run")
def examples_improved_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.improved_rate(deltas(spark, sf_dir), "run"), "improved_rate", places=9)


@query(f"WITH {DELTAS}, m AS (SELECT run, avg(delta) AS d FROM d GROUP BY run) SELECT round(min(d), 6) AS lowest, round(max(d), 6) AS highest FROM m")
def run_delta_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.run_delta_range(deltas(spark, sf_dir)), "lowest", "highest")


#: The values with their weights in all samples; the ends are those of the sorted means.
BOOT = f"""
    w AS ({rs.sql_weights(f"SELECT {rs.sql_key(42, 'example', 'example_id')} AS key, delta FROM pd", f"SELECT b FROM range({rs.SAMPLES}) r(b)")}),
    e AS (SELECT b, CASE WHEN sum(w) > 0 THEN sum(w * delta) / sum(w) ELSE 0 END AS m FROM w GROUP BY b),
    boot AS (SELECT round((SELECT avg(delta) FROM pd), 6) AS value, round(l[{rs.SAMPLES // 40 + 1}], 6) AS lower, round(l[{rs.SAMPLES * 39 // 40 + 1}], 6) AS upper FROM (SELECT list_sort(list(m)) AS l FROM e))
"""


@query(f"WITH {DELTAS}, {BOOT} SELECT * FROM boot")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rs.bootstrap_interval(ev.policy_deltas(deltas(spark, sf_dir))), "value", "lower", "upper")


@query()
def bootstrap_interval_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws a sample as there are examples; by random streams that SQL lacks."""
    from parlance.plans.ordering import global_rank

    ranked = global_rank(ev.policy_deltas(deltas(spark, sf_dir)), [F.col("example_id")], "idx")
    values = materialized(ranked.select((F.col("idx") - 1).alias("idx"), "delta"))
    return rounded(rs.drawn_interval(values), "value", "lower", "upper")


ID = "sha256('{\"dataset_id\":\"d\",\"index\":' || doc_id || ',\"prompt_digest\":\"' || sha256(text) || '\",\"split\":\"valid\"}')"


@query(f"SELECT doc_id, {ID} AS id FROM documents")
def example_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ev.example_id(F.lit("d"), F.col("doc_id"), F.col("text"), F.lit("valid")).alias("id"))


@query(f"SELECT doc_id FROM documents ORDER BY {ID}, doc_id LIMIT 100")
def stable_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id", ev.example_id(F.lit("d"), F.col("doc_id"), F.col("text"), F.lit("valid")).alias("id"))
    return ev.stable_sample(ids, 100, "id", "doc_id").select("doc_id")


@query("SELECT event_id, CAST('0x' || substr(sha256('7:' || event_type || event_id), 9, 8) AS BIGINT) & 2147483647 AS seed FROM events")
def rng_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ev.rng_seed(F.lit(7), F.concat("event_type", "event_id")).alias("seed"))


@query("SELECT e.id AS example_id, s.seed FROM (SELECT DISTINCT doc_id % 200 AS id FROM documents) e, (VALUES (0), (1), (2), (3), (4)) s(seed)")
def cross_examples_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.grid(predictions(spark, sf_dir).select("example_id").distinct(), [0, 1, 2, 3, 4])


@query(f"WITH {PRED}, due AS (SELECT DISTINCT p.example_id, s.seed FROM pred p, (VALUES (0), (1), (2), (99)) s(seed)), got AS (SELECT example_id, seed, count(*) AS n FROM pred GROUP BY ALL) SELECT coalesce(g.example_id, d.example_id) AS example_id, coalesce(g.seed, d.seed) AS seed, CASE WHEN g.n IS NULL THEN 'missing' WHEN d.seed IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM got g FULL JOIN due d ON d.example_id = g.example_id AND d.seed = g.seed WHERE g.n IS NULL OR d.seed IS NULL OR g.n > 1")
def join_pred_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("example_id", "seed")
    return ev.misaligned(p, ev.grid(p.select("example_id").distinct(), [0, 1, 2, 99]))


@query(f"WITH {PRED} SELECT cand_id FROM pred WHERE example_id IN (SELECT example_id FROM pred WHERE seed = 0 AND finish_reason = 'stop')")
def semi_selected_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.join(p.where("seed = 0 AND finish_reason = 'stop'").select("example_id"), "example_id", "left_semi").select("cand_id")


@query(f"WITH {PRED} SELECT example_id, seed, 'prompt_tokens' AS rule FROM pred WHERE n_chars NOT BETWEEN 1 AND 5000 UNION ALL SELECT example_id, seed, 'generated_tokens' FROM pred WHERE n_chars % 300 = 0")
def validate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("prompt_tokens", F.col("n_chars")).withColumn("generated_tokens", F.col("n_chars") % 300)
    return ev.prediction_violations(p, 5000, 512)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'no supervised tokens' WHEN doc_id % 4 = 2 THEN 'boundary changed' ELSE 'too long' END AS error FROM documents WHERE doc_id % 4 > 0")
def validate_row_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 4
    prompt = F.array(F.lit(1), F.lit(2))
    full = F.when(i == 1, prompt).when(i == 2, F.array(F.lit(1), F.lit(3), F.lit(4))).when(i == 3, F.sequence(F.lit(1), F.lit(9))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return ev.token_row_errors(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), full.alias("full"), prompt.alias("prompt")), 8)


@query("SELECT doc_id FROM documents WHERE n_chars > 9000")
def token_limit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.token_limit_errors(table(spark, sf_dir, "documents"), "n_chars", 9000).select("doc_id")


@query(f"WITH {PRED} SELECT example_id, count(*) AS n, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed, cand_id) AS seeds FROM pred GROUP BY example_id")
def group_by_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev.by_example(predictions(spark, sf_dir), "example_id", "seed", "cand_id")
    return g.select("example_id", F.size("outputs").cast("long").alias("n"), F.array_join(F.transform("outputs", lambda o: o["seed"].cast("string")), ",").alias("seeds"))


@query(f"WITH {DELTAS} SELECT example_id, round(max(nll / tokens) FILTER (WHERE run = 1) * {OFF}, 6) AS base, count(*) FILTER (WHERE run <> 1) AS runs FROM s GROUP BY example_id")
def example_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per example the base cost and a map of the runs' costs, here as its size."""
    s = scores(spark, sf_dir).withColumn("m", F.col("nll") / F.col("tokens"))
    per = s.groupBy("example_id").agg(F.max(F.when(F.col("run") == 1, F.col("m"))).alias("base"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("run") != 1, F.struct("run", "m"))))).alias("by_run"))
    return per.select("example_id", F.round(F.col("base") * OFF, 6).alias("base"), F.size("by_run").cast("long").alias("runs"))


@query("SELECT 'o_orderpriority' AS field, count(DISTINCT o_orderpriority) AS n_values FROM orders")
def policy_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("model", F.lit("m"))
    return ev.policy_consistency(o, "o_orderpriority", "model")


@query("SELECT 'fewer training rows than a batch' AS problem UNION ALL SELECT 'no test rows'")
def train_minimums(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") < 3, "train").otherwise("valid").alias("split")).groupBy("split").agg(F.count("*").alias("n"))
    return ev.train_minimums(n, 4, True)


@query("SELECT p_partkey, CAST(ceil(p_partkey / 7.0) * 3 AS BIGINT) AS n FROM part")
def iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ev.iterations(F.col("p_partkey"), 7, 3).alias("n"))


@query(
    f"WITH {FLAGS}, {DELTAS}, {BOOT}, li AS (SELECT {LIKE} FROM s WHERE run <> 1), ra AS (SELECT "
    + ", ".join(f"round(avg(CAST({k} AS INT)), 9) AS {v}" for k, v in RATES.items())
    + " FROM fl) SELECT *, empty_rate <= 0.02 AND format_violation_rate <= 0.02 AND truncation_rate <= 0.03 AS eligible FROM li, boot, ra"
)
def evaluate_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of one policy: likelihood, interval, rates, gates, as one row."""
    s = materialized(scores(spark, sf_dir))
    d = ev.policy_deltas(ev.paired_deltas(s, F.lit(1)))
    interval = rounded(rs.bootstrap_interval(d), "value", "lower", "upper")
    rates = rounded(ev.behavior_rates(flags(spark, sf_dir)), *RATES.values(), places=9)
    whole = materialized(rounded(ev.likelihood(s.where("run <> 1")), *MEASURES).crossJoin(interval).crossJoin(rates))
    limits = {"empty_rate": 0.02, "format_violation_rate": 0.02, "truncation_rate": 0.03}
    return whole.crossJoin(ev.gates(whole, limits).agg(F.bool_and("passed").alias("eligible")))
