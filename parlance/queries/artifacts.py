"""Artifacts: written, found, verified and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.render import example_row
from parlance.operators import artifacts as ar
from parlance.operators import evaluation as ev
from parlance.operators import panel as pn
from parlance.plans.durable import fresh_path
from parlance.plans.spread import spread
from parlance.queries import panel as panel_queries
from parlance.queries.evaluation import SCORES, predictions, rounded, scores
from parlance.queries.registry import query, table


def _round_trip(spark: SparkSession, name: str, part: str, rows: DataFrame, recipe: dict) -> DataFrame:
    """Write twice, verify, and read the part back."""
    root = fresh_path(spark, name)
    one, two = (ar.write_artifact(spark, root, {part: rows}, recipe) for _ in range(2))
    if one != two or ar.list_artifacts(spark, root) != [f"{root}/{one}"]:
        raise ValueError("the same rows gave another artifact")
    ar.verify_artifact(spark, f"{root}/{one}")
    return ar.read_part(spark, f"{root}/{one}", part)


@query("SELECT event_id AS index, props AS prompt FROM events")
def scan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split's rows with the index that was stored with them."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), F.to_json(F.struct(F.col("props").alias("prompt"), F.lit("x").alias("completion"))).alias("value"))
    got = _round_trip(spark, "split", "train.jsonl", e, {"kind": "split"})
    return got.select("index", F.get_json_object("value", "$.prompt").alias("prompt"))


@query("SELECT doc_id % 200 AS example_id, CAST(floor(doc_id / 200.0) AS BIGINT) AS seed, sha256(text) AS digest FROM documents")
def scan_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select(F.col("cand_id").alias("index"), F.to_json(F.struct("example_id", "seed", "text")).alias("value"))
    got = _round_trip(spark, "pred", "pred.jsonl", p, {"kind": "predictions"})
    r = got.select(F.from_json("value", "example_id long, seed long, text string", {"mode": "FAILFAST"}).alias("r"))
    return r.select("r.example_id", "r.seed", F.sha2("r.text", 256).alias("digest"))


@query(f"WITH {panel_queries.J} SELECT ballot_id, dimension, rater_id, choice FROM j")
def scan_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.plans.ordering import global_rank

    j = panel_queries.judgments(spark, sf_dir)
    ranked = global_rank(j, [F.col("ballot_id"), F.col("dimension"), F.col("rater_id")], "index")
    got = _round_trip(spark, "judged", "judgments.jsonl", ranked.select("index", F.to_json(F.struct("ballot_id", "dimension", "rater_id", "choice")).alias("value")), {"kind": "judgments"})
    r = got.select(F.from_json("value", "ballot_id long, dimension string, rater_id long, choice string").alias("r"))
    return r.select("r.*")


@query("SELECT event_id AS index, '{\"messages\":[{\"role\":\"user\",\"content\":' || to_json(props) || '},{\"role\":\"assistant\",\"content\":\"ok\"}]}' AS value FROM events")
def sink_train_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), example_row(F.col("props"), F.lit("ok")).alias("value"))
    return _round_trip(spark, "copy", "train.jsonl", e, {"kind": "copy"})


@query(f"WITH {SCORES} SELECT CAST(run AS BIGINT) AS run, round(avg(nll / tokens), 6) AS macro_mean_nll, round(sum(nll) / sum(tokens), 6) AS corpus_mean_nll FROM s GROUP BY run")
def sink_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each run as an artifact, read back."""
    report = rounded(ev.likelihood(scores(spark, sf_dir), "run"), "macro_mean_nll", "corpus_mean_nll", "corpus_perplexity")
    got = _round_trip(spark, "report", "metrics.jsonl", report.select(F.col("run").cast("long").alias("index"), F.to_json(F.struct(*report.columns)).alias("value")), {"kind": "report"})
    r = got.select(F.from_json("value", "run long, macro_mean_nll double, corpus_mean_nll double", {"mode": "FAILFAST"}).alias("r"))
    return r.select("r.*")


@query(f"WITH {panel_queries.J} SELECT dimension, {panel_queries.COUNTS.format('policy')}, {panel_queries.COUNTS.format('base')} FROM j GROUP BY dimension")
def sink_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = pn.preference_summary(panel_queries.judgments(spark, sf_dir))
    place = F.array_position(F.array(*[F.lit(d) for d in pn.DIMENSIONS]), F.col("dimension"))
    got = _round_trip(spark, "panel", "summary.jsonl", summary.select(place.alias("index"), F.to_json(F.struct(*summary.columns)).alias("value")), {"kind": "panel"})
    return got.select(F.from_json("value", "dimension string, policy long, base long", {"mode": "FAILFAST"}).alias("r")).select("r.*")


@query("SELECT conv_id * 1000 + turn AS index, sha256(text) AS digest FROM conversations")
def sink_chat_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    rows = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    got = _round_trip(spark, "chat", "turns.jsonl", rows, {"kind": "chat", "parent": None})
    return got.select("index", F.sha2(F.get_json_object("value", "$.text"), 256).alias("digest"))


@query("SELECT true AS found, true AS tampering_found, true AS sized")
def verify_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact is found by its name; rows that were added to it are noticed."""
    root = fresh_path(spark, "verify")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("index"), F.to_json(F.struct("n_name")).alias("value"))
    path = f"{root}/{ar.write_artifact(spark, root, {'rows.jsonl': rows}, {'kind': 'test'})}"
    ar.verify_artifact(spark, path)
    size = ar.path_size(spark, path)
    rows.limit(1).select(F.to_json(F.struct(F.lit(99).cast("long").alias("index"), "value")).alias("value")).write.mode("append").text(f"{path}/rows.jsonl")
    try:
        ar.verify_artifact(spark, path)
        noticed = False
    except ValueError:
        noticed = True
    out = table(spark, sf_dir, "region").where("r_regionkey = 0")
    return out.select(F.lit(ar.list_artifacts(spark, root) == [path]).alias("found"), F.lit(noticed).alias("tampering_found"), F.lit(ar.path_size(spark, path) > size > 0).alias("sized"))


@query("SELECT DISTINCT event_id // 1000 AS b FROM events WHERE event_id % 2500 = 7")
def verify_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of a stored split whose rows are no longer what was written: some texts are another's."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), F.to_json(F.struct(F.col("props").alias("prompt"))).alias("value"))
    root = fresh_path(spark, "verified")
    path = f"{root}/{ar.write_artifact(spark, root, {'train.jsonl': rows}, {'kind': 'split'})}"
    ar.verify_artifact(spark, path)
    forged = ar.read_part(spark, path, "train.jsonl").withColumn("value", F.when(F.col("index") % 2500 == 7, F.concat("value", F.lit(" "))).otherwise(F.col("value")))
    return ar.differing_blocks(ar.digest_blocks(forged, "value", "index"), spark.read.parquet(f"{path}/train.jsonl{ar.BLOCKS}"))


@query("SELECT sha256(CAST(s_suppkey AS VARCHAR)) AS name, CASE WHEN s_suppkey % 10 > 1 THEN 'k' || s_nationkey END AS kind, CASE WHEN s_suppkey % 10 > 1 THEN 2 END AS n_files, CASE WHEN s_suppkey % 10 > 1 THEN s_suppkey + 5 END AS n_rows, CASE s_suppkey % 10 WHEN 0 THEN 'unreadable manifest' WHEN 1 THEN 'manifest of another artifact' END AS error FROM supplier")
def scan_artifact_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a manifest for every supplier; some can't be read, some are of another folder."""
    k = F.col("s_suppkey")
    name = F.sha2(k.cast("string"), 256)
    ident = F.when(k % 10 == 1, F.sha2(F.lit("other"), 256)).otherwise(name)
    files = F.create_map(F.lit("a.jsonl"), F.struct(k.cast("long").alias("rows")), F.lit("b.jsonl"), F.struct(F.lit(5).cast("long").alias("rows")))
    body = F.to_json(F.struct(files.alias("files"), F.struct(F.concat(F.lit("k"), "s_nationkey").alias("kind")).alias("recipe"), ident.alias("id")))
    text = F.when(k % 10 == 0, F.substring(body, 1, 20)).otherwise(body)
    root = fresh_path(spark, "folders")
    # a folder for each row: tasks put their files in place themselves, the driver does not move them one by one
    rows = table(spark, sf_dir, "supplier").select(name.alias("artifact"), text.alias("value"))
    spread(rows, "artifact").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("artifact").text(root)
    return ar.scan_artifacts(spark, root, "artifact=*/part-*")
