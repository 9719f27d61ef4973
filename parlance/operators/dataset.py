"""From current messages to prompt and completion: the whole dataset of one person's replies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import render as rd
from parlance.functions.json import canonical_object, value
from parlance.operators import artifacts
from parlance.operators import selection as sel
from parlance.operators.context import context_reactions, disjoint_violations, last_k, timeline
from parlance.plans.durable import materialized


@dataclass(frozen=True)
class Recipe:
    """What a dataset is made of, beside its messages."""

    target: str
    target_name: str
    context: int = 32
    valid: float = 0.1
    test: float = 0.1


def exclusions(messages: DataFrame, target: Column) -> DataFrame:
    """The target's messages with ``reason``, null for those that become examples."""
    mine = messages.where(F.col("author_id") == target)
    return mine.withColumn("reason", sel.exclusion(F.col("text"), F.col("edited_at"), F.col("deleted_at"), F.size("attachments"), F.size("mentions")))


def _named(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Author names and mentions with names, for all messages at once.

    ``names`` has one row per person and joins by id; nobody's messages are one task, since AQE
    splits what a frequent author makes large.
    """
    who = names.select(F.col("person").alias("_p"), F.col("name").alias("_n"))
    authors = messages.join(who, F.col("author_id") == F.col("_p"), "left").withColumnRenamed("_n", "author").drop("_p")
    said = messages.select("message_id", F.explode("mentions").alias("m"), F.lit("body").alias("scope"))
    said = said.union(messages.where("quote IS NOT NULL").select("message_id", F.explode("quote.mentions").alias("m"), F.lit("quote").alias("scope")))
    named = said.join(who, F.col("m.person_id") == F.col("_p"), "left")
    item = F.struct(F.col("m.start").alias("start"), F.col("m.length").alias("length"), F.col("_n").alias("name"))
    lists = named.groupBy("message_id").agg(F.collect_list(F.when(F.col("scope") == "body", item)).alias("body_m"), F.collect_list(F.when(F.col("scope") == "quote", item)).alias("quote_m"))
    quoted = who.withColumnRenamed("_n", "quote_author")
    out = authors.join(lists, "message_id", "left").join(quoted, F.col("quote.author_id") == F.col("_p"), "left").drop("_p")
    return out.withColumn("shown", rd.render_mentions(F.col("text"), F.col("body_m"))).withColumn("quote_shown", rd.render_mentions(F.col("quote.text"), F.col("quote_m")))


def examples(messages: DataFrame, reactions: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per target: split, index, chat_id, target_message_id, target_sent_at, context ids,
    reaction event ids, prompt, completion.

    Only what stood before the target's time, in its chat and after the end of the split before it,
    is in a prompt. A reply's text comes from its quote, else from the context.
    """
    target = F.lit(recipe.target)
    sel.check_ratios(recipe.context, recipe.valid, recipe.test)
    kept = exclusions(messages, target).where("reason IS NULL").select("message_id", "chat_id", "sent_at")
    split = materialized(sel.chronological_split(kept, "sent_at", "message_id", recipe.valid, recipe.test))
    bounds = sel.purge_bounds(split, "sent_at", "message_id")
    targets = split.join(F.broadcast(bounds), "split").select(F.col("message_id").alias("target_id"), F.col("chat_id").alias("chat"), F.col("sent_at").alias("at"), "bound_at", "bound_id", "split", "index")
    targets = materialized(targets)
    plain = messages.select(F.col("message_id").alias("id"), F.col("chat_id").alias("chat"), "sent_at", "edited_at", "deleted_at")
    context = materialized(last_k(plain, targets, recipe.context).select("target_id", "id", "sent_at"))
    reacted = materialized(context_reactions(context, reactions, targets))
    people = sel.all_people(messages.select("author_id", F.transform("mentions", lambda m: m["person_id"]).alias("m"), F.col("quote.author_id").alias("q"), F.transform("quote.mentions", lambda m: m["person_id"]).alias("qm")), "author_id", "m", "q", "qm").union(sel.all_people(reactions, "author_id")).distinct()
    names = materialized(sel.pseudonyms(people, target).withColumnRenamed("pseudonym", "name").union(messages.sparkSession.range(1).select(target.alias("person"), rd.person_name(F.lit(recipe.target_name)).alias("name"))))
    # only what stands in some prompt is rendered; what a reaction is to stands there too
    used = context.select(F.col("id").alias("message_id")).union(targets.select("target_id")).distinct()
    shown = materialized(_named(messages.join(used, "message_id", "left_semi"), names).select(F.col("message_id").alias("id"), "author_id", "author", "shown", "quote_author", "quote_shown", F.col("quote.reply_to").alias("reply_to"), "deleted_at", F.size(F.coalesce("attachments", F.array().cast(messages.schema["attachments"].dataType))).alias("n_att"), F.exists(F.coalesce("mentions", F.array().cast(messages.schema["mentions"].dataType)), lambda m: m["person_id"] == target).alias("to_target"), F.col("text").isNotNull().alias("has_text")))
    # replies: the answered message counts only if it is in the same target's context
    inside = context.select("target_id", F.col("id").alias("reply_to")).join(shown.select(F.col("id").alias("reply_to"), F.col("author").alias("o_author"), F.col("shown").alias("o_shown")), "reply_to")
    own_targets = targets.select("target_id", F.col("target_id").alias("id"), F.lit(True).alias("is_target"))
    items = context.select("target_id", "id", F.lit(False).alias("is_target")).union(own_targets).join(shown, "id")
    items = items.join(inside, ["target_id", "reply_to"], "left")
    reply = rd.reply_text(F.col("reply_to").isNotNull(), F.coalesce("quote_author", "o_author"), F.coalesce("quote_shown", "o_shown"))
    name = rd.person_name(F.lit(recipe.target_name))
    header = rd.message_header(F.col("author"), name, F.col("to_target"), F.col("n_att"), F.col("has_text"), reply)
    body = rd.message_body(F.col("deleted_at"), F.col("shown"), F.col("n_att"))
    items = materialized(items.select("target_id", "id", "is_target", header.alias("header"), body.alias("body"), reply.alias("reply"), "shown"))
    who = names.select(F.col("person").alias("_p"), F.col("name").alias("r_author"))
    subject = shown.select(F.col("id").alias("id"), F.col("author").alias("s_author"))
    lines = reacted.join(reactions.select("event_id", "author_id", "value", "removed"), "event_id").join(who, F.col("author_id") == F.col("_p")).join(subject, "id", "left")
    lines = lines.select("target_id", F.col("event_id").alias("item"), rd.reaction_line(F.col("r_author"), F.col("value"), F.col("removed"), F.col("s_author")).alias("header"), F.lit(None).cast("string").alias("body"), F.lit(1).alias("kind"))
    said = items.where("NOT is_target").select("target_id", F.col("id").alias("item"), "header", "body", F.lit(0).alias("kind"))
    ordered = timeline(context, reacted).join(said.union(lines), ["target_id", "item", "kind"])
    # a target's entries are bounded by the context and the reactions to it
    entry = F.struct("nth", "header", F.col("body").alias("content"), "kind", "item")
    per = ordered.groupBy("target_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    mine = items.where("is_target").select("target_id", "reply", "shown")
    whole = targets.join(mine, "target_id").join(per, "target_id", "left")
    e = F.coalesce("e", F.array().cast(per.schema["e"].dataType))
    ids = lambda k: F.transform(F.filter(e, lambda x: x["kind"] == k), lambda x: x["item"])
    closing = F.concat_ws(" | ", F.lit("next response"), F.col("reply"))
    prompt = rd.conversation(name, F.transform(e, lambda x: F.struct(x["header"].alias("header"), x["content"].alias("content"))), closing)
    return whole.select("split", "index", F.col("chat").alias("chat_id"), F.col("target_id").alias("target_message_id"), F.col("at").alias("target_sent_at"), ids(0).alias("context_message_ids"), ids(1).alias("context_reaction_event_ids"), prompt.alias("prompt"), F.col("shown").alias("completion"))


def message_value(messages: DataFrame) -> Column:
    """Canonical JSON of what a message says, for the digest of a source."""
    stamp = lambda c: value(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "string")
    fields = {c: value(F.col(c), "string") for c in ("message_id", "chat_id", "author_id", "text")}
    fields |= {c: stamp(F.col(c)) for c in ("sent_at", "edited_at", "deleted_at")}
    return canonical_object(fields)


def build(spark: SparkSession, messages: DataFrame, reactions: DataFrame, recipe: Recipe, root: str) -> str:
    """Write the dataset; returns its id. The same messages and recipe give the same id."""
    rows = materialized(examples(messages, reactions, recipe))
    sel.raise_if_any(disjoint_violations(rows.select("split", F.col("target_message_id").alias("target_id"), F.col("context_message_ids").alias("context"))), "sources cross splits")
    parts = {f"{s}.jsonl": rows.where(F.col("split") == s).select("index", F.to_json(F.struct("prompt", "completion")).alias("value")) for s in sel.SPLITS}
    start = {s: i * 10**15 for i, s in enumerate(sel.SPLITS)}
    at = F.col("index") + F.when(F.col("split") == "valid", start["valid"]).when(F.col("split") == "test", start["test"]).otherwise(0)
    entry = F.to_json(F.struct("split", "index", "chat_id", "target_message_id", F.date_format("target_sent_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("target_sent_at"), "context_message_ids", "context_reaction_event_ids"))
    parts["index.jsonl"] = rows.select(at.alias("index"), entry.alias("value"))
    return artifacts.write_artifact(spark, root, parts, recipe.__dict__.copy())
