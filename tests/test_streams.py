"""Streams: files that grow, counts on the way, bounded dedup, generations as sessions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_parsing import SIX, envelope, group, parse

from parlance.operators import revisions as rv
from parlance.sources import tail
from parlance.streaming import ingest as st

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_last_line_end(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 4)
    path = tmp_path / "f"
    path.write_bytes(b"one\ntwo two two\nthree\nfou")
    ends = [tail.last_line_end(str(path), s, n) for s, n in ((0, 100), (0, 5), (0, 4), (0, 2), (4, 3), (4, 12), (22, 50), (16, 1))]
    assert ends == [22, 4, 4, 4, 16, 16, 22, 22]


@pytest.mark.parametrize("known", [True, False])
def test_growing_files_restart_in_mid_file(spark, tmp_path, known):
    """Lines come once each, in bounded batches, over restarts in the middle of a file and of a line."""
    spark.dataSource.register(tail.GrowingFiles)
    folder, checkpoint, out = tmp_path / "in", str(tmp_path / "checkpoint"), str(tmp_path / "out")
    folder.mkdir()

    def run():
        reader = spark.readStream.format("growing_lines").option("path", str(folder)).option("batchBytes", 40).option("rangeBytes", 15)
        reader = reader.option("checkpoint", checkpoint) if known else reader
        query = st.ingest(reader.load(), out, checkpoint, available_now=False)
        query.processAllAvailable()
        query.stop()

    a = "".join(f"a line {i}\n" for i in range(20))
    (folder / "a").write_text(a[:75])
    run()
    (folder / "a").write_text(a)
    (folder / "b").write_text("first\n\nthird\r\nhalf")
    run()
    run()
    (folder / "b").write_text("first\n\nthird\r\nhalf a line\n")
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted((r["file"], r["value"]) for r in rows) == sorted([*(("a", f"a line {i}") for i in range(20)), *(("b", x) for x in ("first", "", "third", "half a line"))])
    assert all(a[r["offset"] :].startswith(r["value"] + "\n") for r in rows if r["file"] == "a")
    if known:
        sizes = {}
        for r in rows:
            sizes[r["batch"]] = sizes.get(r["batch"], 0) + len(r["value"]) + 1
        assert max(sizes.values()) <= 41


def test_counts_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    """Counted while the events are stored, over a restart."""
    more = [envelope(at=5000 + i, dataMessage=group(f"m{i}", 5000 + i)) for i in range(5)]
    events = parse(spark, SIX + SIX[:2] + more + more[:3])
    want = rv.harvest_counts(events, "seq").first().asDict()
    rows = events.collect()
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        st.ingest_counted(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert st.counted(spark, str(tmp_path / "out")).first().asDict() == want
    assert spark.read.parquet(str(tmp_path / "out/events")).select("id").distinct().count() == want["stored"]


def feed(spark, tmp_path, schema, batches, make):
    """What a query gives when each batch of rows comes as a file of its own; a late marker at the end closes windows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_bounded_dedup(spark, tmp_path):
    """An id comes once within the watermark; its state goes, so long after it counts anew."""
    rows = [[("x", at(0)), ("x", at(5)), ("y", at(8))], [("x", at(20)), ("z", at(400))], [("w", at(800))], [("x", at(900))]]
    got = feed(spark, tmp_path, "id string, arrived_at timestamp", rows, lambda s: st.deduplicated(s, "60 seconds"))
    ids = [r["id"] for r in got]
    assert sorted(ids) == ["w", "x", "x", "y", "z"]


def test_generations_are_sessions(spark, tmp_path):
    schema = "turn_id string, at timestamp, kind string, place int"
    one = [("t1", at(0), "start", 0), ("t1", at(2), "token", 1), ("t1", at(3), "token", 2), ("t1", at(3), "token", 2), ("t1", at(4), "end", 3)]
    two = [("t2", at(1), "start", 0), ("t2", at(2), "cancel", 1), ("t3", at(1), "start", 0), ("t3", at(3), "token", 1)]
    # in other order, again, and too late
    batches = [one[1:] + two[:1], [one[0], one[2], *two[1:]], [("end", at(500), "start", 0)], [("t1", at(5), "token", 9)], [("end", at(900), "start", 0)]]
    got = {r["turn_id"]: tuple(r)[2:] for r in feed(spark, tmp_path, schema, batches, lambda s: st.turn_sessions(s, "60 seconds", "30 seconds"))}
    assert got["t1"] == (2000.0, 2, 4.0, 0.5, "done")
    assert got["t2"] == (None, 0, 1.0, 0.0, "cancelled")
    assert got["t3"] == (2000.0, 1, 2.0, 0.5, "timeout")


def test_upserts_give_only_what_a_batch_changes(spark, tmp_path):
    """Batches in which older and equal revisions come after newer ones, over a restart; none of the keys goes through Python."""
    batches = [
        [("a", 2, 1, "new"), ("a", 1, 2, "old"), ("b", 5, 1, "gone"), ("c", 1, 1, "x")],
        [("a", 2, 1, "again"), ("b", 4, 9, "older"), ("c", 1, 2, "y"), ("d", 1, 1, None)],
        [("a", 3, 1, "newer"), ("c", 1, 1, "x"), ("d", 1, 1, None)],
    ]
    got = {}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, st.REVISION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = st.upserts(spark.readStream.schema(st.REVISION).parquet(str(tmp_path / "in")))
        assert "Pandas" not in out._jdf.queryExecution().analyzed().toString()
        st.ingest(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"), mode="update").awaitTermination()
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r["batch"], set()).add((r["key"], r["revision"], r["seq"], r["body"]))
    assert got == {0: {("a", 2, 1, "new"), ("b", 5, 1, "gone"), ("c", 1, 1, "x")}, 1: {("c", 1, 2, "y"), ("d", 1, 1, None)}, 2: {("a", 3, 1, "newer")}}


def test_micro_batches_are_written_by_all_cores(spark, tmp_path):
    """A stream made of a table comes in three batches, none of them in a file of its own."""
    from parlance.plans.spread import parts
    from parlance.queries import ingest

    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"))
    stream = ingest._stream_of(spark, rows, str(tmp_path))
    st.ingest(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert len(list((tmp_path / "in").glob("part-*"))) >= parts(spark) > 3
    assert got.select("batch").distinct().count() == 3 and {r["seq"] for r in got.collect()} == set(range(500))


def test_counts_and_corpus_parse_once(spark, sf_dir):
    """What several tables are made of is parsed before, not again in each."""
    from parlance.queries import QUERIES
    from parlance.queries.dataset import corpus

    for df in (QUERIES["store_stats"](spark, sf_dir), *corpus(spark, sf_dir)):
        assert "parse_json" not in df._jdf.queryExecution().optimizedPlan().toString()
