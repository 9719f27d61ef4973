"""From an event's JSON to at most one record: a message, an edit, a deletion or a reaction.

Everything is a projection over one VARIANT column, so a batch and a stream parse alike. Events
that the rules leave out are ``skipped``; events that break them are ``invalid`` and say why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import variants as v
from parlance.functions.unicode import on_boundary
from parlance.plans.fence import fenced

RANGE = "struct<start:int,length:int,uuid:string,number:string,recipient:string,name:string>"
FILE = "struct<id:string,contentType:string,filename:string,size:long>"
#: What an envelope and its message can hold, each read in one go. Where the type of a value tells whether it
#: counts it stays a VARIANT; what is not an object or a list where one is due is null.
ENVELOPE = "struct<source:variant,sourceUuid:variant,sourceNumber:variant,sourceName:variant,timestamp:variant,dataMessage:variant,editMessage:struct<targetSentTimestamp:variant,dataMessage:variant>,syncMessage:struct<sentMessage:variant>>"
ROOT = f"struct<account:variant,envelope:{ENVELOPE}>"
QUOTE = f"struct<id:variant,author:variant,authorUuid:variant,authorNumber:variant,text:variant,message:variant,mentions:array<{RANGE}>>"
REACTION = "struct<emoji:variant,targetAuthor:variant,targetAuthorUuid:variant,targetAuthorNumber:variant,targetSentTimestamp:variant,isRemove:variant>"
DATA = f"struct<timestamp:variant,message:variant,groupInfo:struct<groupId:variant>,mentions:array<{RANGE}>,attachments:array<{FILE}>,quote:{QUOTE},reaction:{REACTION},remoteDelete:struct<timestamp:variant>>"


def unwrap_rpc(event: Column) -> Column:
    """The parameters (or their result) of a ``receive`` call, and anything else as it is."""
    at = lambda path: F.try_variant_get(event, path, "variant")
    inner = F.when(v.is_object(at("$.params.result")), at("$.params.result")).otherwise(at("$.params"))
    return F.when(v.text(at("$.method")) == "receive", inner).otherwise(event)


def read_root(event: Column) -> Column:
    """``struct<account, envelope>`` of an event that was unwrapped."""
    return F.try_variant_get(event, "$", ROOT)


def select_payload(envelope: Column) -> Column:
    """An edit's message, else a message, else one sent from another device."""
    found = (envelope["editMessage"]["dataMessage"], envelope["dataMessage"], envelope["syncMessage"]["sentMessage"])
    return F.coalesce(*[F.when(v.is_object(x), x) for x in found])


def read_data(message: Column) -> Column:
    return F.try_variant_get(message, "$", DATA)


def is_edit(envelope: Column) -> Column:
    return v.is_object(envelope["editMessage"]["dataMessage"])


def edit_target(envelope: Column) -> Column:
    return F.when(is_edit(envelope), v.integer(envelope["editMessage"]["targetSentTimestamp"]))


def is_self(envelope: Column) -> Column:
    return v.is_object(envelope["syncMessage"]["sentMessage"])


def resolve_author(envelope: Column, root: Column) -> Column:
    """Own messages: uuid, else the account; others: uuid, number, source. Empty texts don't count."""
    other = v.first_text(envelope["sourceUuid"], envelope["sourceNumber"], envelope["source"])
    own = v.first_text(envelope["sourceUuid"], root["account"])
    return F.when(is_self(envelope), own).otherwise(other)


def hashed(kind: str, raw: Column, source: str = "signal") -> Column:
    return F.concat(F.lit(f"{source}-{kind}:"), F.sha2(raw, 256))


def message_key(chat: Column, author: Column, millis: Column, source: str = "signal") -> Column:
    """The id of a message, from what all its revisions share."""
    return hashed("message", F.concat(chat, F.lit("\0"), author, F.lit("\0"), millis.cast("string")), source)


def millis_to_ts(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def mention_name(name: Column) -> Column:
    """Without leading @ and with single spaces; null if nothing is left but a placeholder."""
    plain = F.regexp_replace(F.regexp_replace(name, "(?U)^\\s+|\\s+$", ""), "^@+", "")
    spaced = F.regexp_replace(F.regexp_replace(plain, "(?U)\\s+", " "), "^ | $", "")
    return F.when(~spaced.isin("", "￼"), spaced)


def mentions(raw: Column, source: str = "signal") -> Column:
    """``array<struct<person_id, start, length, name>>`` from an array of RANGE; null: none."""
    items = F.coalesce(raw, F.array().cast(f"array<{RANGE}>"))

    def one(m: Column) -> Column:
        who = F.coalesce(F.nullif(m["uuid"], F.lit("")), F.nullif(m["number"], F.lit("")), F.nullif(m["recipient"], F.lit("")))
        return F.struct(hashed("person", who, source).alias("person_id"), m["start"].alias("start"), m["length"].alias("length"), mention_name(m["name"]).alias("name"))

    return F.transform(items, one)


def mention_error(text: Column, found: Column) -> Column:
    """Why these mentions don't fit this text, or null.

    A range starts in the text, has a length, ends on character boundaries and overlaps no other.
    """
    bad_range = F.exists(found, lambda m: F.coalesce((m["start"] < 0) | (m["length"] < 1), F.lit(True)))
    split = F.exists(found, lambda m: ~(on_boundary(text, m["start"]) & on_boundary(text, m["start"] + m["length"])))
    # after sorting, each range must start where the one before has ended or later
    spans = F.array_sort(F.transform(found, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b"))))
    overlap = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit(False).alias("bad")), lambda s, x: F.struct(x["b"].alias("at"), (s["bad"] | (x["a"] < s["at"])).alias("bad")))["bad"]
    some = F.size(found) > 0
    return (
        F.when(some & text.isNull(), "mentions without text")
        .when(some & F.exists(found, lambda m: m["person_id"].isNull()), "mention without identity")
        .when(some & bad_range, "mention range")
        .when(some & split, "mention boundary")
        .when(some & overlap, "mention overlap")
    )


def attachments(raw: Column, source: str = "signal") -> Column:
    """``array<struct<id, media_type, name, size>>``; items without an id get one from place and name."""
    items = F.coalesce(raw, F.array().cast(f"array<{FILE}>"))

    def one(a: Column, i: Column) -> Column:
        key = F.coalesce(a["id"], F.concat(i.cast("string"), F.lit(":"), F.coalesce(a["filename"], F.lit(""))))
        return F.struct(hashed("attachment", key, source).alias("id"), a["contentType"].alias("media_type"), a["filename"].alias("name"), a["size"].alias("size"))

    return F.transform(items, one)


def reply(q: Column, chat_id: Column, source: str = "signal") -> Column:
    """``struct<reply_to, author_id, sent_at, text, mentions>`` of a quote with author and time, else null."""
    author, at = v.first_text(q["authorUuid"], q["authorNumber"], q["author"]), v.integer(q["id"])
    person = hashed("person", author, source)
    # a text that is present but null does not fall back to the message
    text = F.when(F.is_variant_null(q["text"]), F.lit(None)).otherwise(F.coalesce(v.text(q["text"]), v.text(q["message"])))
    made = F.struct(message_key(chat_id, person, at, source).alias("reply_to"), person.alias("author_id"), millis_to_ts(at).alias("sent_at"), text.alias("text"), mentions(q["mentions"], source).alias("mentions"))
    return F.when(author.isNotNull() & at.isNotNull(), made)


def parse_events(events: DataFrame, chats: list[str], source: str = "signal") -> DataFrame:
    """One row per event (``id, payload`` and what else it has) with ``kind``, ``error`` and the record.

    ``kind``: message, edit, delete, reaction, skipped, invalid. Record columns: ``message_id,
    chat_id, author_id, author_name, is_self, sent_at, event_at, text, quote, edited_at, deleted_at,
    attachments, mentions, value, removed``; a reaction's ``message_id`` is its target. Groups that
    are not in ``chats`` are skipped, and so are direct messages. A plan without a shuffle: columns that
    nobody asks for are not worked out.
    """
    e = fenced(events, F.try_parse_json("payload").alias("_event"))
    e = fenced(e, read_root(unwrap_rpc(F.col("_event"))).alias("_root"))
    e = fenced(e, read_data(select_payload(F.col("_root.envelope"))).alias("_data"))
    root, env, data = F.col("_root"), F.col("_root")["envelope"], F.col("_data")
    reaction, edit = data["reaction"], edit_target(env)
    sent_ms = F.coalesce(F.nullif(edit, F.lit(0)), v.integer(data["timestamp"]), v.integer(env["timestamp"]))
    e = fenced(
        e,
        data.isNotNull().alias("_found"),
        v.text(data["groupInfo"]["groupId"]).alias("_group"),
        hashed("person", resolve_author(env, root), source).alias("author_id"),
        v.text(env["sourceName"]).alias("author_name"),
        is_self(env).alias("is_self"),
        F.coalesce(v.integer(env["timestamp"]), v.integer(data["timestamp"])).alias("_event_ms"),
        sent_ms.alias("_sent_ms"),
        is_edit(env).alias("_is_edit"),
        (is_edit(env) & edit.isNull()).alias("_no_target"),
        reaction.isNotNull().alias("_is_reaction"),
        v.integer(data["remoteDelete"]["timestamp"]).alias("_deleted_ms"),
        data["remoteDelete"].isNotNull().alias("_is_delete"),
        hashed("person", v.first_text(reaction["targetAuthorUuid"], reaction["targetAuthorNumber"], reaction["targetAuthor"]), source).alias("_target"),
        v.integer(reaction["targetSentTimestamp"]).alias("_target_ms"),
        v.text(reaction["emoji"]).alias("value"),
        v.flag(reaction["isRemove"], False).alias("removed"),
        v.text(data["message"]).alias("text"),
        F.coalesce(~v.kind(data["message"]).isin("STRING", "VOID"), F.lit(False)).alias("_odd_text"),
        mentions(data["mentions"], source).alias("mentions"),
        attachments(data["attachments"], source).alias("attachments"),
        data["quote"].alias("_quote"),
    )
    e = fenced(e, hashed("chat", F.col("_group"), source).alias("chat_id"))
    e = fenced(e, reply(F.col("_quote"), F.col("chat_id"), source).alias("quote"))
    wanted = F.col("_found") & F.coalesce(F.col("_group").isin(list(chats)), F.lit(False))
    empty = F.col("text").isNull() & (F.size("attachments") == 0)
    bare = ~F.col("_is_reaction") & ~F.col("_is_delete")
    wrong_quote = mention_error(F.col("quote.text"), F.coalesce(F.col("quote.mentions"), F.array().cast(e.schema["mentions"].dataType)))
    error = (
        F.when(F.col("payload").isNull(), "not an object")
        .when(~wanted, F.lit(None))
        .when(F.col("_no_target"), "edit without target")
        .when(F.col("author_id").isNull(), "no author")
        .when(F.col("_event_ms").isNull(), "no timestamp")
        .when(F.col("_is_reaction"), F.when(F.col("_target").isNull() | F.col("_target_ms").isNull() | F.col("value").isNull(), "reaction target"))
        .when(F.col("_is_delete"), F.when(F.col("_deleted_ms").isNull(), "delete timestamp"))
        .when(F.col("_odd_text"), "text is not text")
        .otherwise(F.coalesce(mention_error(F.col("text"), F.col("mentions")), F.when(~empty, wrong_quote)))
    )
    e = fenced(e, error.alias("error"))
    kind = F.when(F.col("error").isNotNull(), "invalid").when(~wanted | (bare & empty), "skipped").when(F.col("_is_reaction"), "reaction").when(F.col("_is_delete"), "delete").when(F.col("_is_edit"), "edit").otherwise("message")
    e = fenced(e, kind.alias("kind"))
    whole = F.col("kind").isin("message", "edit")
    person = F.when(F.col("kind") == "reaction", F.col("_target")).otherwise(F.col("author_id"))
    ms = F.when(F.col("kind") == "reaction", F.col("_target_ms")).when(F.col("kind") == "delete", F.col("_deleted_ms")).otherwise(F.col("_sent_ms"))
    event_at = millis_to_ts(F.col("_event_ms"))
    real = ~F.col("kind").isin("invalid", "skipped")
    return e.select(
        *events.columns,
        "kind",
        "error",
        F.when(real, message_key(F.col("chat_id"), person, ms, source)).alias("message_id"),
        *[F.when(real, F.col(c)).alias(c) for c in ("chat_id", "author_id", "author_name", "is_self")],
        F.when(real, F.when(F.col("kind") == "reaction", event_at).otherwise(millis_to_ts(ms))).alias("sent_at"),
        F.when(real, event_at).alias("event_at"),
        F.when(whole, F.col("text")).alias("text"),
        F.when(whole, F.col("quote")).alias("quote"),
        F.when(F.col("kind") == "edit", event_at).alias("edited_at"),
        F.when(F.col("kind") == "delete", event_at).alias("deleted_at"),
        F.when(whole, F.col("attachments")).alias("attachments"),
        F.when(whole, F.col("mentions")).alias("mentions"),
        F.when(F.col("kind") == "reaction", F.col("value")).alias("value"),
        F.when(F.col("kind") == "reaction", F.col("removed")).alias("removed"),
    )
