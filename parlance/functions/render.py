"""Model text of messages: headers, bodies, replies, reactions, whole conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.json import quoted
from parlance.functions.unicode import cut, units

MENTION = "struct<start:int,length:int,name:string>"


def person_name(name: Column) -> Column:
    """One safe name: no leading @, single spaces, no brackets or bars; null if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(name, "(?U)^\\s+|\\s+$", ""), "^@+", "")
    spaced = F.regexp_replace(F.regexp_replace(plain, "(?U)\\s+", " "), "^ | $", "")
    return F.nullif(F.translate(spaced, "[]|", "()/"), F.lit(""))


def render_mentions(text: Column, mentions: Column) -> Column:
    """``text`` with each range of UTF-16 units replaced by @ and a name.

    An @ right before a range is part of the mention, unless the range starts with one itself.
    ``mentions``: array<struct<start, length, name>> of valid ranges; null and empty change nothing.
    """
    ordered = F.array_sort(F.transform(mentions, lambda m: F.struct(m["start"].cast("int").alias("start"), m["length"].cast("int").alias("length"), m["name"].alias("name"))))

    def step(s: Column, m: Column) -> Column:
        before, own = cut(text, s["at"], m["start"]), cut(text, m["start"], m["start"] + m["length"])
        short = F.when(before.endswith("@") & ~own.startswith("@"), F.substring(before, F.lit(1), F.length(before) - 1)).otherwise(before)
        return F.struct(F.concat(s["out"], short, F.lit("@"), m["name"]).alias("out"), (m["start"] + m["length"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], cut(text, s["at"], units(text))))
    return F.when(F.size(F.coalesce(mentions, F.array().cast(f"array<{MENTION}>"))) > 0, done).otherwise(text)


def reply_text(is_reply: Column, author: Column, text: Column) -> Column:
    """What a header says of a reply: whom it answers and, where known, what; null for others."""
    whom = F.when(author.isNull(), "reply to an earlier message").otherwise(F.concat(F.lit("reply to "), author))
    return F.when(is_reply, F.when(text.isNotNull(), F.concat(whom, F.lit(": "), quoted(text))).otherwise(whom))


def message_header(author: Column, target_name: Column, mentions_target: Column, n_attachments: Column, has_text: Column, reply: Column) -> Column:
    """Author, mention of the target, attachments beside a text, reply; parted by bars."""
    label = F.when(n_attachments == 1, "1 attachment").otherwise(F.concat(n_attachments.cast("string"), F.lit(" attachments")))
    parts = F.array(author, F.when(mentions_target, F.concat(F.lit("mentions @"), target_name)), F.when((n_attachments > 0) & has_text, label), reply)
    return F.array_join(F.array_compact(parts), " | ")


def message_body(deleted: Column, text: Column, n_attachments: Column) -> Column:
    return F.when(deleted.isNotNull(), "[deleted message]").when(text.isNotNull(), text).when(n_attachments > 0, "[attachment]").otherwise("[empty message]")


def reaction_line(author: Column, value: Column, removed: Column, subject_author: Column) -> Column:
    subject = F.when(subject_author.isNull(), "an earlier message").otherwise(F.concat(subject_author, F.lit("'s message")))
    kept = F.concat(author, F.lit(" reacted "), quoted(value), F.lit(" to "), subject)
    gone = F.concat(author, F.lit(" removed "), quoted(value), F.lit(" reaction from "), subject)
    return F.when(removed, gone).otherwise(kept)


def conversation(target_name: Column, entries: Column, next_response: Column | None = None) -> Column:
    """The whole prompt. ``entries``: array<struct<header, content>>; a null content has no line."""
    head = F.concat(F.lit("You are "), target_name, F.lit(". Write only "), target_name, F.lit("'s next message."))
    lines = F.transform(entries, lambda e: F.concat_ws("\n", F.concat(F.lit("\n["), e["header"], F.lit("]")), e["content"]))
    last = F.concat(F.lit("\n["), F.lit("next response") if next_response is None else next_response, F.lit("]"))
    return F.concat_ws("\n", head, F.lit("\nConversation:"), F.array_join(lines, "\n") if entries is not None else F.lit(None), last)


def format_turns(prompt: Column, *, prefix: str = "", suffix: str = "", system: str = "", prompt_role: str = "user", completion_role: str = "assistant", prefill: str = "", style: str = "chat") -> Column:
    """``array<struct<role, content>>`` that a model is given for a prompt.

    ``completion`` style has neither a system turn nor roles of its own.
    """
    if style not in ("chat", "completion"):
        raise ValueError("style must be chat or completion")
    roles = {"system", "user", "assistant"}
    if style == "chat" and not {prompt_role, completion_role} <= roles:
        raise ValueError("unknown role")
    if style == "completion" and system:
        raise ValueError("completion style has no system turn")
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.concat(F.lit(prefix), prompt, F.lit(suffix))
    turns = [turn("system", F.lit(system))] if system else []
    turns.append(turn(prompt_role if style == "chat" else "user", body))
    if prefill:
        turns.append(turn(completion_role if style == "chat" else "assistant", F.lit(prefill)))
    return F.array(*turns)


def example_row(prompt: Column, completion: Column, *, prefix: str = "", suffix: str = "", system: str = "", prefill: str = "", ending: str = "") -> Column:
    """JSON of one training row in chat style."""
    said = F.concat(F.lit(prefill), completion, F.lit(ending))
    turns = format_turns(prompt, prefix=prefix, suffix=suffix, system=system)
    return F.to_json(F.struct(F.concat(turns, F.array(F.struct(F.lit("assistant").alias("role"), said.alias("content")))).alias("messages")))
