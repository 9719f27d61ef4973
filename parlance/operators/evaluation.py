"""Evaluation statistics over predictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions.json import canonical_object, value

TRUNCATED = ("length", "max_tokens")


def example_id(dataset: Column, index: Column, prompt: Column, split: Column) -> Column:
    fields = {"dataset_id": value(dataset, "string"), "index": value(index, "number"), "prompt_digest": value(F.sha2(prompt, 256), "string"), "split": value(split, "string")}
    return F.sha2(canonical_object(fields), 256)


def low31(digest: Column) -> Column:
    """The low 31 bits of a hex digest's first 8 bytes."""
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def rng_seed(seed: Column, example: Column) -> Column:
    return low31(F.sha2(F.concat(seed.cast("string"), F.lit(":"), example), 256))


def chat_seed(seed: Column, digest: Column, attempt: Column) -> Column:
    return low31(F.sha2(F.concat_ws(":", seed.cast("string"), digest, attempt.cast("string")), 256))


def stable_sample(rows: DataFrame, limit: int, by: str, index: str) -> DataFrame:
    """All rows for limit 0, else the ``limit`` rows smallest by ``by``; in the order of ``index``."""
    kept = rows.orderBy(by, index).limit(limit) if limit else rows
    return kept.orderBy(index)


def grid(examples: DataFrame, seeds: list[int]) -> DataFrame:
    """Every example with every seed, as predictions are expected."""
    return examples.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])))


def misaligned(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """``example_id, seed, problem`` of predictions that lack, that nobody expects, or that repeat."""
    key = ["example_id", "seed"]
    got = predictions.groupBy(*key).agg(F.count("*").alias("n"))
    both = expected.select(*key, F.lit(True).alias("due")).join(got, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select(*key, problem.alias("problem")).where("problem IS NOT NULL")


def prediction_violations(predictions: DataFrame, max_prompt: int, max_tokens: int) -> DataFrame:
    """``example_id, seed, rule`` for every value out of its range."""
    c = F.col
    rules = [
        F.when(~c("finish_reason").isin("stop", "length") | c("finish_reason").isNull(), "finish_reason"),
        F.when(c("text").isNull(), "text"),
        F.when(~c("prompt_tokens").between(1, max_prompt), "prompt_tokens"),
        F.when(~c("generated_tokens").between(1, max_tokens), "generated_tokens"),
    ]
    return predictions.select("example_id", "seed", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def diagnostics(predictions: DataFrame, matches: DataFrame, exact: DataFrame, threshold: int) -> DataFrame:
    """One row of flags per prediction. ``predictions``: cand_id, text, prompt, finish_reason and more."""
    flagged = predictions.join(matches, "cand_id", "left").join(exact.select("cand_id", F.lit(True).alias("_exact")), "cand_id", "left")
    longest = F.coalesce("longest", F.lit(0))
    return flagged.select(
        *predictions.columns,
        (tx.strip(F.col("text")) == "").alias("empty"),
        tx.format_violation(F.col("text")).alias("format_violation"),
        tx.unknown_mention(F.col("text"), F.col("prompt")).alias("unknown_mention"),
        F.col("finish_reason").isin(*TRUNCATED).alias("truncated"),
        (longest >= threshold).alias("long_training_match"),
        longest.cast("long").alias("longest_training_match"),
        F.coalesce("_exact", F.lit(False)).alias("exact_training_match"),
    )


def rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("int"))


def behavior_rates(flags: DataFrame, *by: str) -> DataFrame:
    names = {"empty": "empty_rate", "format_violation": "format_violation_rate", "unknown_mention": "unknown_mention_rate", "truncated": "truncation_rate", "long_training_match": "long_training_match_rate", "exact_training_match": "exact_training_match_rate"}
    return flags.groupBy(*by).agg(*[rate(k).alias(v) for k, v in names.items()])


def cross_prompt_duplicates(texts: DataFrame, norm: str) -> DataFrame:
    """One row ``rate``: of the texts that aren't empty, those that repeat one before; 0 without any."""
    counts = texts.where(F.col(norm) != "").groupBy(F.sha2(norm, 256).alias("d")).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1) / F.sum("n"), F.lit(0.0)).alias("rate"))


def within_prompt_duplicates(texts: DataFrame, norm: str, example: str) -> DataFrame:
    """One row ``rate``: the share of examples of whose outputs two are equal, empty ones included."""
    counts = texts.groupBy(example, F.sha2(norm, 256).alias("d")).agg(F.count("*").alias("n"))
    per = counts.groupBy(example).agg(F.max("n").alias("most"))
    return per.agg(F.avg((F.col("most") > 1).cast("int")).alias("rate"))


def profile(texts: DataFrame, text: str, *by: str) -> DataFrame:
    """The mean of every style feature."""
    made = texts.select(*by, *[f.alias(name) for name, f in tx.features(F.col(text)).items()])
    return made.groupBy(*by).agg(*[F.avg(n).alias(n) for n in tx.FEATURES])


def profile_difference(texts: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: the absolute difference of every feature's mean."""
    ref = reference.select(*[F.col(n).alias(f"r_{n}") for n in tx.FEATURES])
    return texts.crossJoin(F.broadcast(ref)).select(*[F.abs(F.col(n) - F.col(f"r_{n}")).alias(n) for n in tx.FEATURES])


def safe_exp(x: Column) -> Column:
    return F.exp(F.least(x, F.lit(700.0)))


def likelihood(scores: DataFrame, *by: str) -> DataFrame:
    """Mean over examples, mean over tokens, perplexity. ``scores``: example_id, tokens, nll."""
    corpus = F.sum("nll") / F.sum("tokens")
    return scores.groupBy(*by).agg(F.avg(F.col("nll") / F.col("tokens")).alias("macro_mean_nll"), corpus.alias("corpus_mean_nll"), safe_exp(corpus).alias("corpus_perplexity"))


def paired_deltas(scores: DataFrame, base_run: Column, run: str = "run") -> DataFrame:
    """``example_id, run, delta`` of each run's mean cost to the base's, for examples that both have."""
    cost = scores.withColumn("m", F.col("nll") / F.col("tokens"))
    base = cost.where(F.col(run) == base_run).select("example_id", F.col("m").alias("b"))
    return cost.where(F.col(run) != base_run).join(base, "example_id").select("example_id", run, (F.col("m") - F.col("b")).alias("delta"))


def policy_deltas(deltas: DataFrame) -> DataFrame:
    """``example_id, delta``: the mean over runs."""
    return deltas.groupBy("example_id").agg(F.avg("delta").alias("delta"))


def improved_rate(deltas: DataFrame, *by: str) -> DataFrame:
    return deltas.groupBy(*by).agg(F.avg((F.col("delta") < 0).cast("int")).alias("improved_rate"))


def run_delta_range(deltas: DataFrame, run: str = "run") -> DataFrame:
    means = deltas.groupBy(run).agg(F.avg("delta").alias("d"))
    return means.agg(F.min("d").alias("lowest"), F.max("d").alias("highest"))


def gates(values: DataFrame, limits: dict[str, float]) -> DataFrame:
    """``gate, value, limit, passed, eligible`` from one row of values; eligible if all pass."""
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("value"), F.lit(x).alias("limit"), (F.col(g) <= x).alias("passed")) for g, x in limits.items()])
    every = F.forall(rows, lambda r: r["passed"])
    return values.select(every.alias("eligible"), F.inline(rows)).select("gate", "value", "limit", "passed", "eligible")


def incremental_memorization(policy: Column, base: Column, reference: Column) -> Column:
    return F.greatest(F.lit(0.0), policy - F.greatest(base, reference))


def by_example(predictions: DataFrame, example: str, *columns: str) -> DataFrame:
    """Per example its outputs as an array in the order of the columns."""
    return predictions.groupBy(example).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("outputs"))


def token_row_errors(rows: DataFrame, max_length: int) -> DataFrame:
    """``id, error`` from (id, full, prompt), arrays of tokens: what keeps a row from training."""
    full, prompt = F.col("full"), F.col("prompt")
    error = (
        F.when(full.isNull() | prompt.isNull() | (F.size(full) == 0) | (F.size(prompt) == 0), "invalid tokens")
        .when(F.size(full) <= F.size(prompt), "no supervised tokens")
        .when(F.slice(full, F.lit(1), F.size(prompt)) != prompt, "boundary changed")
        .when(F.size(full) > max_length, "too long")
    )
    return rows.select("id", error.alias("error")).where("error IS NOT NULL")


def token_limit_errors(rows: DataFrame, tokens: str, limit: int) -> DataFrame:
    return rows.where(F.col(tokens) > limit)


def policy_consistency(runs: DataFrame, *columns: str) -> DataFrame:
    """``field, n_values`` of what the runs of one policy must share but don't."""
    counts = runs.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_values")) for c in columns])
    return counts.select(F.inline(rows)).where("n_values <> 1")


def train_minimums(counts: DataFrame, batch_size: int, test: bool) -> DataFrame:
    """``problem`` rows from (split, n)."""
    wide = counts.agg(*[F.coalesce(F.max(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("train", "valid", "test")])
    problems = [F.when(F.col("train") == 0, "no training rows"), F.when(F.col("train").between(1, batch_size - 1), "fewer training rows than a batch"), F.when(F.col("valid") == 0, "no validation rows")]
    if test:
        problems.append(F.when(F.col("test") == 0, "no test rows"))
    return wide.select(F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def iterations(n_train: Column, batch_size: int, epochs: int) -> Column:
    return (F.ceil(n_train / batch_size) * epochs).cast("long")
