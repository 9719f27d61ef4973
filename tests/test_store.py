"""The store: whole versions or none, batches once, buckets written where they change."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_parsing import SIX, envelope, group, parse

from parlance.operators import parsing as p
from parlance.operators import revisions as rv
from parlance.operators.store import Conflict, MessageStore
from parlance.plans.bucketed import bucketed
from parlance.plans.durable import fresh_path, materialized


def texts(store, version=None):
    return sorted(r["text"] for r in store.messages(version).collect())


def test_harvest_is_atomic_and_idempotent(spark):
    store = MessageStore(spark, fresh_path(spark, "store"), 4)
    rows = materialized(parse(spark, SIX + SIX[:1]))
    assert store.commit(rows.where("seq >= 0"), batch=0) == 1
    assert (store.events().count(), store.messages().count(), store.reactions().count()) == (4, 2, 1)
    assert texts(store) == ["Edited message", "My reply"]
    # the same again, as the same batch and as another one
    assert store.commit(rows, batch=0) == 1 and store.versions() == [1]
    assert store.commit(rows, batch=1) == 2
    assert (store.events().count(), store.messages().count(), store.reactions().count()) == (4, 2, 1)
    # a writer dies between its tables and its manifest: the old version is whole, and the batch can be run again
    more = materialized(parse(spark, [envelope(at=9000, dataMessage=group("late", 9000))]).withColumn("seq", F.col("seq") + 100))

    def die():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.commit(more, batch=2, before_manifest=die)
    assert texts(store) == ["Edited message", "My reply"] and store.versions() == [1, 2]
    assert store.commit(more, batch=2) == 3
    assert texts(store) == ["Edited message", "My reply", "late"] and texts(store, 2) == ["Edited message", "My reply"]
    # of two writers of one version one wins
    with pytest.raises(Conflict):
        store.commit(materialized(parse(spark, [envelope(at=9100, dataMessage=group("x", 9100))])), before_manifest=lambda: store.commit(more.withColumn("id", F.lit("other"))))
    assert store.versions() == [1, 2, 3, 4]
    assert store.expire() > 0 and store.versions() == [4] and "late" in texts(store)
    assert store.expire() == 0


def test_an_older_revision_that_comes_later_changes_nothing(spark):
    store = MessageStore(spark, fresh_path(spark, "store"), 4)
    rows = materialized(parse(spark, SIX))
    store.commit(rows.where("kind = 'edit'"))
    store.commit(rows.where("kind = 'message'"))
    assert texts(store) == ["Edited message", "My reply"]


def test_reindex_writes_changed_buckets_only(spark):
    store = MessageStore(spark, fresh_path(spark, "store"), 8)
    events = [envelope(f"u{i}", 1000 + i, dataMessage=group(f"text {i}", 1000 + i)) for i in range(40)]
    store.commit(parse(spark, events))
    again = lambda raw: p.parse_events(raw, ["g"])
    assert store.reindex(again) == {"messages": [], "reactions": []} and store.versions() == [1]
    before = store.manifest().messages

    def other(raw):
        rows = again(raw)
        return rows.withColumn("text", F.when(F.col("text") == "text 7", "changed").otherwise(F.col("text")))

    changed = store.reindex(other)
    assert len(changed["messages"]) == 1 and "changed" in texts(store)
    after = store.manifest().messages
    assert [b for b in before if before[b] != after[b]] == [str(changed["messages"][0])]
    # events that give nothing any more
    fewer = lambda raw: again(raw).withColumn("kind", F.when(F.col("text") == "text 7", "invalid").otherwise(F.col("kind")))
    assert store.reindex(fewer, keep_stale=True) == {"messages": [], "reactions": []} and len(texts(store)) == 40
    assert len(store.reindex(fewer)["messages"]) == 1 and len(texts(store)) == 39


def test_buckets_need_no_exchange(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = materialized(parse(spark, SIX).drop("payload"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = bucketed(rv.current_messages(rows, "seq"), "message_id", "sent_at", buckets=4)
        r = bucketed(rv.current_reactions(rows), "message_id", "sent_at", buckets=4)
        whole = rv.with_children(m, r)
        assert "hashpartitioning(message_id" not in plan(whole)
        assert {x["text"]: len(x["reactions"]) for x in whole.collect()} == {"Edited message": 1, "My reply": 0}
        newest = rv.latest_revision(bucketed(rows.where("kind <> 'reaction'").withColumn("at", rv.revision_at()), "message_id", buckets=4), "message_id", "at", "seq")
        assert "hashpartitioning(message_id" not in plan(newest)
        mine = rv.scan_messages(m, F.lit(json.loads('"someone"')))
        assert "EqualTo(author_id,someone)" in plan(mine)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled(spark) -> int:
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), None).iterator()
    n = 0
    while stages.hasNext():
        n += stages.next().shuffleWriteBytes()
    return n


def test_whole_rows_are_shuffled_once(spark):
    import random

    store = MessageStore(spark, fresh_path(spark, "store"), 4)
    draw = random.Random(1)
    events = [envelope(f"u{i}", 1000 + i, dataMessage=group(draw.randbytes(1500).hex(), 1000 + i)) for i in range(200)]
    rows = materialized(parse(spark, events))
    size, start = 200 * 3000, shuffled(spark)
    store.commit(rows.where("seq < 100"))
    # some that are there already, and the rest
    store.commit(rows.where("seq >= 90"))
    committed = shuffled(spark)
    assert store.events().count() == 200 and len(texts(store)) == 200 and committed - start < 1.5 * size
    assert not any(store.reindex(lambda raw: p.parse_events(raw, ["g"])).values()) and shuffled(spark) - committed < size / 4
