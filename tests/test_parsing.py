"""Events of every kind, as a messenger sends them."""

from __future__ import annotations

import hashlib
import json

import pytest

from parlance.functions.unicode import on_boundary, units
from parlance.operators import parsing as p
from parlance.operators import revisions as rv
from parlance.sources.events import identify_lines


def envelope(source="u1", at=1000, **body):
    return {"account": "me", "envelope": {"source": source, "sourceName": source.upper(), "timestamp": at, **body}}


def group(message=None, at=1000, **more):
    return {"timestamp": at, "message": message, "groupInfo": {"groupId": "g"}, **more}


def parse(spark, events):
    lines = spark.createDataFrame([(json.dumps(e) if not isinstance(e, str) else e,) for e in events], "value string")
    from pyspark.sql import functions as F

    rows = identify_lines(lines).withColumn("seq", F.monotonically_increasing_id())
    return p.parse_events(rows, ["g"])


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


SIX = [
    envelope(dataMessage=group("one", attachments=[{"id": "a", "contentType": "image/png", "size": 3}])),
    envelope(at=1100, dataMessage={"timestamp": 1100, "message": "direct"}),
    envelope(at=1200, dataMessage={"timestamp": 1200, "message": "other", "groupInfo": {"groupId": "h"}}),
    envelope("me2", 1300, syncMessage={"sentMessage": group("My reply", 1300, quote={"id": 1000, "author": "u1", "text": "one"})}),
    envelope("u2", 1400, dataMessage=group(None, 1400, reaction={"emoji": "x", "targetAuthor": "u1", "targetSentTimestamp": 1000})),
    envelope(at=1500, editMessage={"targetSentTimestamp": 1000, "dataMessage": group("Edited message", 1500)}),
]


def test_harvest(spark):
    rows = parse(spark, SIX + SIX[:1])
    assert rv.harvest_counts(rows, "seq").first().asDict() == {"received": 7, "stored": 4, "messages": 3, "reactions": 1, "skipped": 2, "duplicates": 1}
    current = {r["text"]: r for r in rv.current_messages(rows, "seq").collect()}
    assert set(current) == {"Edited message", "My reply"}
    edited, reply = current["Edited message"], current["My reply"]
    assert edited["edited_at"] is not None and edited["attachments"] == []
    assert reply["is_self"] and reply["author_id"] == "signal-person:" + sha("me")
    assert reply["quote"]["reply_to"] == edited["message_id"]
    chat, author = "signal-chat:" + sha("g"), "signal-person:" + sha("u1")
    assert edited["message_id"] == "signal-message:" + sha(f"{chat}\0{author}\0{1000}")


def test_delete_leaves_a_tombstone(spark):
    rows = parse(spark, [envelope(at=2000, dataMessage={"timestamp": 2000, "groupInfo": {"groupId": "g"}, "remoteDelete": {"timestamp": 1000}}), SIX[0]])
    only = rv.current_messages(rows, "seq").collect()
    assert len(only) == 1 and only[0]["text"] is None and only[0]["deleted_at"] is not None


@pytest.mark.parametrize(
    ("start", "length", "error"),
    [(3, 1, None), (0, 2, None), (1, 1, "mention boundary"), (3, 9, "mention boundary"), (-1, 1, "mention range"), (3, 0, "mention range")],
)
def test_mention_ranges_count_utf16_units(spark, start, length, error):
    text = "\U0001f600 ￼ tail"
    row = parse(spark, [envelope(dataMessage=group(text, mentions=[{"start": start, "length": length, "uuid": "x", "name": " @Ann  B "}]))]).first()
    assert row["error"] == error
    if not error:
        assert row["mentions"][0]["name"] == "Ann B"


def test_errors_say_why(spark):
    overlap = [{"start": 0, "length": 2, "uuid": "x"}, {"start": 1, "length": 2, "uuid": "y"}]
    bad = [
        "[1]",
        envelope("", dataMessage=group("x")),
        envelope(dataMessage=group("abcd", mentions=overlap)),
        envelope(dataMessage=group(5)),
        envelope(editMessage={"dataMessage": group("x")}),
        envelope(dataMessage=group(None, reaction={"emoji": "x"})),
    ]
    assert sorted(r["error"] for r in parse(spark, bad).collect()) == sorted(["not an object", "no author", "mention overlap", "text is not text", "edit without target", "reaction target"])


def test_units(spark):
    df = spark.createDataFrame([("a\U0001f600b",)], "t string")
    from pyspark.sql import functions as F

    flags = df.select(units(F.col("t")), *[on_boundary(F.col("t"), F.lit(i)) for i in range(6)]).first()
    assert list(flags) == [4, True, True, False, True, True, False]


def test_rpc_and_empty_tables(spark):
    wrapped = {"method": "receive", "params": {"result": SIX[0]}}
    assert parse(spark, [wrapped]).first()["kind"] == "message"
    assert parse(spark, ["  "]).count() == 0


def test_newest_revision_wins_in_any_order(spark):
    rows = [("k", 2, 1, "b"), ("k", 1, 2, "a"), ("k", 2, 3, "c"), ("n", 1, 1, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, rev int, seq int, v string")
        got = {r["k"]: r["v"] for r in rv.latest_revision(df, "k", "rev", "seq").collect()}
        assert got == {"k": "c", "n": None}
