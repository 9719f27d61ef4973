"""A store of events and the messages they make, under versions.

A version is one small manifest that names the folders of all its tables. A writer puts its folders in place first
and the manifest last, by one rename that fails if the version is there: readers see all tables of a version or none,
a reader that holds a version keeps it, and a writer that dies leaves nothing but folders that no manifest names.

Messages and reactions lie in buckets by message id. A commit reads and writes only the buckets that its records
fall into; a rebuild compares digests of buckets and writes those that differ.

Whole rows are shuffled once at most, to the bucket they are written to. What decides about them (ids that repeat,
messages that change, rows that differ) is found from hashes, and bitmaps of these tell which rows can stay where they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import artifacts
from parlance.operators.revisions import current_reactions, distinct_events, revision_at
from parlance.plans.bitmaps import broadcast_bitmap, hash_place, may_hold
from parlance.plans.durable import materialized
from parlance.plans.spread import parts

#: Columns that order the events of a store by arrival: the commit, then the place in it.
ARRIVAL = ("version", "place")
GONE = ("skipped", "invalid")
REVISIONS = ("message", "edit", "delete")
#: The rows are full of hexadecimal digests, which take half the bytes in it.
CODEC = "zstd"
#: What parsing adds to an event.
RECORD = ("kind", "error", "message_id", "chat_id", "author_id", "author_name", "is_self", "sent_at", "event_at", "text", "quote", "edited_at", "deleted_at", "attachments", "mentions", "value", "removed")


class Conflict(RuntimeError):
    """Another writer has put the same version in place."""


@dataclass(frozen=True)
class Manifest:
    """``events``: folders; ``messages``, ``reactions``: the folder of each bucket that has rows; ``writers``: each writer's last batch."""

    version: int
    buckets: int
    events: tuple[str, ...]
    messages: dict[str, str]
    reactions: dict[str, str]
    writers: dict[str, int]


class MessageStore:
    """Events, current messages and reactions below ``root``, as ``parse_events`` makes them.

    ``order`` is the column by which a batch's events arrived.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, order: str = "seq"):
        self.spark, self.root, self.buckets, self.order = spark, root.rstrip("/"), buckets, order

    def _bucket(self, key: str = "message_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        fs, where = artifacts._files(self.spark, f"{self.root}/versions")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """Of a version, the newest unless named; an empty one where there is none."""
        if version is None:
            there = self.versions()
            if not there:
                return Manifest(0, self.buckets, (), {}, {}, {})
            version = there[-1]
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.root}/versions/{version:012d}.json").collect())
        made = json.loads(text)
        if made["buckets"] != self.buckets:
            raise ValueError(f"the store has {made['buckets']} buckets")
        return Manifest(**made | {"events": tuple(made["events"])})

    def _publish(self, new: Manifest) -> None:
        fs, temporary = artifacts._files(self.spark, f"{self.root}/.tmp-{uuid.uuid4().hex}.json")
        out = fs.create(temporary, False)
        out.write(bytearray(artifacts.canonical(new.__dict__).encode()))
        out.close()
        if not artifacts.move(self.spark, str(temporary.toString()), f"{self.root}/versions/{new.version:012d}.json"):
            fs.delete(temporary, False)
            raise Conflict(f"version {new.version} is there")

    def _read(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*sorted(paths)) if paths else None

    def events(self, version: int | None = None) -> DataFrame | None:
        return self._read(list(self.manifest(version).events))

    def messages(self, version: int | None = None) -> DataFrame | None:
        return self._read(list(self.manifest(version).messages.values()))

    def reactions(self, version: int | None = None) -> DataFrame | None:
        return self._read(list(self.manifest(version).reactions.values()))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows with ``bucket`` and ``slice``, dealt to tasks by these: several to a bucket where there are more tasks than buckets."""
        slices = max(1, parts(self.spark) // self.buckets)
        part = F.pmod(F.shiftrightunsigned(F.xxhash64("message_id"), 32), F.lit(slices)).cast("int")
        return rows.withColumn("bucket", self._bucket()).withColumn("slice", part).repartition("bucket", "slice")

    def _newest(self, dealt: DataFrame, order: Column) -> DataFrame:
        """Of dealt rows the last of each message in ``order``, found where they lie."""
        columns = [c for c in dealt.columns if c not in ("bucket", "slice")]
        best = dealt.groupBy("bucket", "message_id", "slice").agg(F.max_by(F.struct(*columns), order).alias("_best"))
        return best.select("bucket", *["message_id" if c == "message_id" else F.col(f"_best.{c}").alias(c) for c in columns])

    def _put(self, rows: DataFrame, folder: str) -> None:
        """Add rows that have ``bucket`` to a folder by it; tasks write what they have, ordered by message."""
        rows.sortWithinPartitions("bucket", "message_id").write.mode("append").option("compression", CODEC).partitionBy("bucket").parquet(folder)

    def _folders(self, folder: str, buckets: list[int]) -> dict[str, str]:
        return {str(b): f"{folder}/bucket={b}" for b in buckets}

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets that have rows; one number for each bucket at most."""
        return sorted(r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def commit(self, parsed: DataFrame, writer: str = "batch", batch: int | None = None, before_manifest: Callable[[], None] | None = None) -> int:
        """Add the events of ``parsed`` that have records and that the store lacks; returns the version.

        Of rows that repeat an id the first counts. With a ``batch`` number, a batch that this writer has
        committed already adds nothing. ``before_manifest`` is called when all folders are in place.
        """
        old = self.manifest()
        if batch is not None and old.writers.get(writer, -1) >= batch:
            return old.version
        version, base = old.version + 1, f"{self.root}/data/{uuid.uuid4().hex}"
        known = self.events(old.version) if old.version else None
        new = self._unknown(parsed, known).where(~F.col("kind").isin(*GONE))
        placed = new.withColumn("version", F.lit(version)).withColumn("place", F.col(self.order))
        placed.write.option("compression", CODEC).parquet(f"{base}/events")
        new = self.spark.read.schema(placed.schema).parquet(f"{base}/events")
        revisions = new.drop("payload").where(F.col("kind").isin(*REVISIONS)).withColumn("revision_at", revision_at())
        folders: dict[str, dict[str, str]] = {}
        for name, rows in (("messages", revisions), ("reactions", current_reactions(new))):
            there, folder = getattr(old, name), f"{base}/{name}"
            touched = self._touched(rows)
            folders[name] = there | self._folders(folder, touched)
            if not touched:
                continue
            before = self._read([there[str(b)] for b in touched if str(b) in there])
            if name == "messages":
                if before is not None:
                    changing = may_hold(broadcast_bitmap(rows.select(hash_place("message_id").alias("h")), "h"), "message_id")
                    rows, before = before.where(changing).unionByName(rows), before.where(~changing)
                self._put(self._newest(self._dealt(rows), F.struct("revision_at", *ARRIVAL)), folder)
            else:
                self._put(self._dealt(rows).drop("slice"), folder)
            if before is not None:
                self._put(before.withColumn("bucket", self._bucket()), folder)
        if before_manifest:
            before_manifest()
        writers = old.writers | ({writer: batch} if batch is not None else {})
        self._publish(Manifest(version, self.buckets, (*old.events, f"{base}/events"), folders["messages"], folders["reactions"], writers))
        return version

    def _unknown(self, parsed: DataFrame, known: DataFrame | None) -> DataFrame:
        """The rows of ``parsed`` whose ids ``known`` lacks; of rows that repeat an id the first.

        Only rows whose id may be there more than once are brought together, the others stay where they are.
        """
        ids = parsed.select(hash_place("id").alias("h"), F.lit(1).alias("here"))
        if known is not None:
            ids = ids.unionByName(known.select(hash_place("id").alias("h"), F.lit(0).alias("here")))
        often = materialized(ids.groupBy("h").agg(F.count("*").alias("n"), F.max("here").alias("here")).where("n > 1 AND here = 1").select("h"))
        if often.isEmpty():
            return parsed
        repeats = may_hold(broadcast_bitmap(often, "h"), "id")
        again = distinct_events(parsed.where(repeats), self.order)
        if known is not None:
            again = again.join(known.select("id").where(repeats), "id", "left_anti").select(*parsed.columns)
        return parsed.where(~repeats).unionByName(again)

    def reindex(self, parse: Callable[[DataFrame], DataFrame], keep_stale: bool = False) -> dict[str, list[int]]:
        """Make messages and reactions anew from the stored events; returns the buckets that changed, by table.

        An event's reactions are those that it gives now: what it gave before goes. Messages and reactions that no
        event gives any more go as well, unless ``keep_stale``: then they stay as they are. Buckets whose rows are
        the same are not written again, and without a change there is no new version.
        """
        old = self.manifest()
        if not old.events:
            return {"messages": [], "reactions": []}
        raw = self.events(old.version).drop(*RECORD)
        parsed = materialized(parse(raw).where(F.col("kind").isin(*REVISIONS, "reaction")).drop("payload"), CODEC)
        made = {"messages": parsed.where(F.col("kind").isin(*REVISIONS)).withColumn("revision_at", revision_at()), "reactions": current_reactions(parsed)}
        folders, changed, base = {}, {}, f"{self.root}/data/{uuid.uuid4().hex}"
        for name, fresh in made.items():
            there = getattr(old, name)
            before = self._read(list(there.values()))
            if before is not None:
                fresh = fresh.select(*before.columns)
            stale = before if keep_stale else None
            find = self._current if name == "messages" else self._given
            want = self._digests(find(self._hashed(fresh, name), self._hashed(stale, name)))
            have = self._digests(self._hashed(before, name))
            changed[name] = sorted(b for b in want | have if want.get(b) != have.get(b))
            written = [b for b in changed[name] if b in want]
            if written:
                some = self._bucket().isin(written)
                if name == "messages":
                    marked = fresh.where(some).withColumn("_fresh", F.lit(1))
                    if stale is not None:
                        marked = marked.unionByName(stale.where(some).withColumn("_fresh", F.lit(0)))
                    rows = self._newest(self._dealt(marked), F.struct("_fresh", "revision_at", *ARRIVAL)).drop("_fresh")
                else:
                    rows = self._dealt(self._given(fresh, stale).where(some)).drop("slice")
                self._put(rows, f"{base}/{name}")
            folders[name] = {b: p for b, p in there.items() if int(b) not in changed[name]} | self._folders(f"{base}/{name}", written)
        if any(changed.values()):
            self._publish(Manifest(old.version + 1, self.buckets, old.events, folders["messages"], folders["reactions"], old.writers))
        return changed

    def _hashed(self, rows: DataFrame | None, name: str) -> DataFrame | None:
        """Of each row what decides which rows are current, and a hash of the whole row."""
        if rows is None:
            return None
        keys = ("message_id", "revision_at", *ARRIVAL) if name == "messages" else ("event_id",)
        return rows.select(*keys, self._bucket().alias("b"), F.xxhash64(F.to_json(F.struct(*rows.columns))).alias("h"))

    def _current(self, fresh: DataFrame, stale: DataFrame | None) -> DataFrame:
        """The newest row of each message, of those made now where there are any."""
        marked = fresh.withColumn("_fresh", F.lit(1))
        if stale is not None:
            marked = marked.unionByName(stale.withColumn("_fresh", F.lit(0)))
        return marked.groupBy("message_id", "b").agg(F.max_by("h", F.struct("_fresh", "revision_at", *ARRIVAL)).alias("h"))

    def _given(self, fresh: DataFrame, stale: DataFrame | None) -> DataFrame:
        """The reactions that events give now, and those of events that give none."""
        return fresh if stale is None else fresh.unionByName(stale.join(fresh.select("event_id"), "event_id", "left_anti"))

    def _digests(self, hashed: DataFrame | None) -> dict[int, tuple]:
        """Rows of each bucket and the sum of their hashes; one row for each bucket."""
        if hashed is None:
            return {}
        got = hashed.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
        return {r["b"]: (r["n"], r["s"]) for r in got.collect()}

    def expire(self, keep: int = 1) -> int:
        """Forget all versions but the newest ``keep``, and folders that none of these names; returns how many went.

        Folders of writers that are at work now are not named yet, so no writer may run meanwhile.
        """
        fs, data = artifacts._files(self.spark, f"{self.root}/data")
        there = self.versions()
        for v in there[:-keep]:
            fs.delete(artifacts._files(self.spark, f"{self.root}/versions/{v:012d}.json")[1], False)
        named = set()
        for v in there[-keep:]:
            m = self.manifest(v)
            named |= {p.removeprefix(f"{self.root}/data/").split("/")[0] for p in (*m.events, *m.messages.values(), *m.reactions.values())}
        gone = [s.getPath() for s in (fs.listStatus(data) if fs.exists(data) else []) if s.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
