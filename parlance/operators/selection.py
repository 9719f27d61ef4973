"""Which messages become examples, how they are split, and who is called what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.plans.ordering import global_rank

REASONS = ("attachment", "deleted", "edited", "no_text", "no_visible_text")
SPLITS = ("train", "valid", "test")


def check_ratios(context: int, valid: float, test: float) -> None:
    if context < 1:
        raise ValueError("context must be at least 1")
    if not (0 <= valid < 1 and 0 <= test < 1 and valid + test < 1):
        raise ValueError("ratios must be in [0, 1) and leave a part for training")


def available_before(at: Column, sent: Column, edited: Column, deleted: Column) -> Column:
    """Whether a message stood in its current form, sent, edited and deleted, before ``at``."""
    return F.greatest(sent, edited, deleted) < at


def exclusion(text: Column, edited: Column, deleted: Column, n_attachments: Column, n_mentions: Column) -> Column:
    """The first reason that keeps a message from being a target, or null."""
    visible = F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f￼]", "") != ""
    return (
        F.when(deleted.isNotNull(), "deleted")
        .when(edited.isNotNull(), "edited")
        .when(n_attachments > 0, "attachment")
        .when(text.isNull(), "no_text")
        .when(~visible & (n_mentions == 0), "no_visible_text")
    )


def selection_audit(candidates: DataFrame, reason: str = "reason") -> DataFrame:
    """One row: all candidates, included, excluded and each reason's count."""
    why = F.col(reason)
    return candidates.agg(
        F.count("*").alias("target_messages"),
        F.count_if(why.isNull()).alias("included"),
        F.count_if(why.isNotNull()).alias("excluded"),
        *[F.count_if(why == r).alias(r) for r in REASONS],
    )


def people_summary(messages: DataFrame, author: str, name: Column, sent: str, ident: str, own: Column) -> DataFrame:
    """Per author: the last name that is not empty, messages, first and last time, whether it is the owner."""
    order = F.struct(sent, ident)
    named = F.when(name.isNotNull() & (name != ""), name)
    return messages.groupBy(F.col(author).alias("person")).agg(
        F.max_by(named, F.when(named.isNotNull(), order)).alias("name"),
        F.count("*").alias("messages"),
        F.min(sent).alias("first_at"),
        F.max(sent).alias("last_at"),
        F.bool_or(own).alias("is_self"),
    )


def self_identity(people: DataFrame) -> DataFrame:
    """The one person that is the owner: no row and several rows both fail when the job runs."""
    found = people.where("is_self").agg(F.count("*").alias("n"), F.min("person").alias("person"))
    problem = F.raise_error(F.concat(F.lit("expected one own identity, found "), F.col("n").cast("string")))
    return found.select(F.when(F.col("n") == 1, F.col("person")).otherwise(problem.cast(people.schema["person"].dataType)).alias("person"))


def holdout(total: int, ratio: float) -> int:
    return max(1, int(total * ratio)) if ratio else 0


def chronological_split(targets: DataFrame, sent: str, ident: str, valid: float, test: float) -> DataFrame:
    """``targets`` with ``split`` and ``index`` (from 0 within the split), in one order over all chats.

    The last rows are the test split, those before the validation split; a split that is asked for
    gets a row at least. Two counts reach the driver, and numbering is done by key range.
    """
    total = targets.count()
    n_valid, n_test = holdout(total, valid), holdout(total, test)
    n_train = total - n_valid - n_test
    if n_train < 1:
        raise ValueError("too few targets for the splits that are asked for")
    rank = F.col("_rank")
    ranked = global_rank(targets, [F.col(sent), F.col(ident)], "_rank")
    split = F.when(rank <= n_train, "train").when(rank <= n_train + n_valid, "valid").otherwise("test")
    start = F.when(rank <= n_train, 0).when(rank <= n_train + n_valid, n_train).otherwise(n_train + n_valid)
    return ranked.select(*targets.columns, split.alias("split"), (rank - 1 - start).cast("long").alias("index"))


def split_counts(splits: DataFrame) -> DataFrame:
    """Rows of each split, zero included."""
    names = splits.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in SPLITS])).alias("split"))
    counts = splits.groupBy("split").agg(F.count("*").alias("n"))
    return names.join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def purge_bounds(splits: DataFrame, sent: str, ident: str) -> DataFrame:
    """For each split the key of the last target before it (null before the first that has rows).

    Three rows, so the window over them is as small as it looks.
    """
    last = splits.groupBy("split").agg(F.max(F.struct(F.col(sent).alias("at"), F.col(ident).alias("id"))).alias("last"))
    names = splits.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in SPLITS])).alias("ord", "split"))
    filled = names.join(last, "split", "left")
    earlier = filled.select(F.col("ord").alias("o"), F.col("last").alias("l"))
    bound = filled.join(earlier, F.col("o") < F.col("ord"), "left").groupBy("split", "ord").agg(F.max("l").alias("bound"))
    return bound.select("split", F.col("bound.at").alias("bound_at"), F.col("bound.id").alias("bound_id"))


def pseudonyms(people: DataFrame, target: Column) -> DataFrame:
    """``person, pseudonym`` for everyone but the target, numbered in the order of the ids as text."""
    ids = people.select(F.col(people.columns[0]).cast("string").alias("person")).where(F.col("person").isNotNull() & (F.col("person") != target.cast("string"))).distinct()
    ranked = global_rank(ids, [F.col("person")], "_n")
    return ranked.select("person", F.concat(F.lit("person_"), F.when(F.col("_n") < 10, F.concat(F.lit("0"), F.col("_n").cast("string"))).otherwise(F.col("_n").cast("string"))).alias("pseudonym"))


def selection_violations(audit: DataFrame, counts: DataFrame) -> DataFrame:
    """``rule`` for each identity that an audit's counts break, given the rows of each split."""
    names = ["target_messages", "included", "excluded", *REASONS]
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_rows"))
    bad = F.lit(False)
    for n in names:
        bad = bad | F.col(n).isNull() | (F.col(n) < 0)
    reasons = sum((F.col(r) for r in REASONS), F.lit(0))
    rules = [
        F.when(bad, "a count is absent or negative"),
        F.when(F.col("included") != F.col("_rows"), "counts differ from the splits"),
        F.when(F.col("target_messages") != F.col("included") + F.col("excluded"), "included and excluded differ from all"),
        F.when(F.col("excluded") != reasons, "excluded differs from the reasons"),
    ]
    return audit.crossJoin(F.broadcast(total)).select(F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def pseudonym_violations(names: DataFrame, target: Column) -> DataFrame:
    """``person, rule`` for each pseudonym that is empty or not unique, and for one of the target."""
    n, own = F.col("pseudonym"), F.col("person") == target.cast("string")
    rules = [F.when(own, "target has a pseudonym"), F.when(n.isNull() | (n == ""), "no name")]
    bad = names.select("person", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    twice = names.where("pseudonym <> ''").groupBy("pseudonym").agg(F.count("*").alias("_k")).where("_k > 1")
    return bad.union(names.join(twice, "pseudonym", "left_semi").select("person", F.lit("name is not unique").alias("rule")))


def all_people(messages: DataFrame, *columns: str) -> DataFrame:
    """Distinct ids over several columns; arrays count with their elements."""
    out = None
    for c in columns:
        is_array = messages.schema[c].dataType.typeName() == "array"
        part = messages.select((F.explode(c) if is_array else F.col(c)).alias("person")).where("person IS NOT NULL").distinct()
        out = part if out is None else out.union(part)
    return out.distinct()


def message_violations(messages: DataFrame, reactions: DataFrame) -> DataFrame:
    """``id, rule`` for every rule that a message, its reply or its reactions break.

    ``messages``: id, chat, sent_at, edited_at, deleted_at, reply_to, author, quote_author,
    quote_sent_at. ``reactions``: event_id, message_id, chat, sent_at. A reply to a message that
    isn't there breaks none.
    """
    own = messages.select("id", F.explode(F.array_compact(F.array(
        F.when(F.col("edited_at") < F.col("sent_at"), "edit before send"),
        F.when(F.col("deleted_at") < F.col("sent_at"), "delete before send"),
        F.when(F.col("quote_sent_at").isNotNull() & F.col("reply_to").isNull(), "quote without reply"),
        F.when(F.col("quote_sent_at") >= F.col("sent_at"), "quote not earlier"),
    ))).alias("rule"))
    twice = messages.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("rule"))
    goal = messages.select(F.col("id").alias("g_id"), F.col("chat").alias("g_chat"), F.col("sent_at").alias("g_at"), F.col("author").alias("g_author"))
    replies = messages.where("reply_to IS NOT NULL").join(goal, F.col("reply_to") == F.col("g_id"))
    bad = (F.col("g_chat") != F.col("chat")) | (F.col("g_at") >= F.col("sent_at"))
    other = (F.col("quote_author") != F.col("g_author")) | (F.col("quote_sent_at") != F.col("g_at"))
    reply = replies.select("id", F.explode(F.array_compact(F.array(F.when(bad, "reply target"), F.when(other, "quote differs from target")))).alias("rule"))
    again = reactions.groupBy("event_id").agg(F.count("*").alias("n"), F.min("message_id").alias("id")).where("n > 1").select("id", F.lit("duplicate reaction").alias("rule"))
    target = messages.select("id", F.col("chat").alias("m_chat"), F.col("sent_at").alias("m_at"))
    late = reactions.join(target, F.col("message_id") == F.col("id")).where((F.col("chat") != F.col("m_chat")) | (F.col("sent_at") < F.col("m_at")))
    return own.union(twice).union(reply).union(again).union(late.select("id", F.lit("reaction").alias("rule")))


def raise_if_any(violations: DataFrame, what: str) -> None:
    found = violations.take(3)
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")
