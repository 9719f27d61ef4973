"""Exact deduplication by composable polynomial fingerprints, verified by comparing the texts.

A text is cut into chunks; each chunk's polynomial value modulo two primes is computed by itself,
and values combine by length-shifted arithmetic: ``h(xy) = h(x) * B**len(y) + h(y)``. So the parts
of a huge document are dealt out to tasks, hashed in any order and combined afterwards. Rows whose
fingerprint and length are shared are then compared with one representative, part by part; should a
fingerprint ever stand for two texts, its rows are grouped by the text itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import column, stored
from parlance.llm.hashing import broadcast_bitmap, hit

CHUNK = 4096
#: (modulus, base); products with a byte summed over a chunk stay below 2**63.
FIELDS = ((2147483647, 1000003), (2147483629, 8191037))
#: Bytes from which on a text is huge, and of its parts.
HUGE, PART = 8 << 20, 1 << 20
#: Members of one group that compare with one copy of the representative.
PER_COPY = 256


def _powers(p: int, base: int) -> np.ndarray:
    out = np.ones(CHUNK + 1, np.int64)
    for i in range(1, CHUNK + 1):
        out[i] = out[i - 1] * base % p
    return out


_tables: list = []


def values(text) -> list[int]:
    """The text's value in each field. Only one chunk at a time is widened to numbers."""
    if not _tables:
        _tables.extend(_powers(*f) for f in FIELDS)
    data, out = np.frombuffer(text, np.uint8), [0] * len(FIELDS)
    for at in range(0, len(data), CHUNK):
        chunk = data[at : at + CHUNK].astype(np.int64) + 1
        for i, ((p, _), power) in enumerate(zip(FIELDS, _tables, strict=True)):
            own = int((chunk * power[len(chunk) - 1 :: -1][: len(chunk)]).sum()) % p
            out[i] = (out[i] * int(power[len(chunk)]) + own) % p
    return out


def combine(p: int, base: int, left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """(value, length) of a concatenation."""
    return (left[0] * pow(base, right[1], p) + right[0]) % p, left[1] + right[1]


def joined(parts: list[int]) -> int:
    """62 bits of the values in both fields."""
    return parts[0] << 31 | parts[1]


def fingerprint(text: bytes) -> int:
    return joined(values(text))


def _prints(bits):
    """bits: of the fingerprint that count (tests lower it to force collisions)."""

    def run(batches):
        for batch in batches:
            fp = [fingerprint(t.as_buffer()) & (1 << bits) - 1 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp, pa.int64())], names=[*batch.schema.names, "fp"])

    return run


def _maybe_shared(bitmap):
    """Rows whose fingerprint the bitmap of shared ones may hold."""

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            yield batch.filter(pa.array(hit(bitmap.value, fp << 2)))

    return run


def _part_values(batches):
    for batch in batches:
        own = [values(t.as_buffer()) for t in batch.column("part")]
        cols = [batch.column(c) for c in ("text_sha256", "n_bytes", "i")]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array([v[i] for v in own], pa.int64()) for i in range(2)), pa.array([len(t.as_buffer()) for t in batch.column("part")], pa.int64())], names=["text_sha256", "n_bytes", "i", "v0", "v1", "n"])


def _combined(bits):
    def run(batches):
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                whole = []
                for f, (p, base) in enumerate(FIELDS):
                    at = (0, 0)
                    for x in parts:
                        at = combine(p, base, at, (x[f"v{f}"], x["n"]))
                    whole.append(at[0])
                out.append(joined(whole) & (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("text_sha256"), batch.column("n_bytes"), pa.array(out, pa.int64())], names=["text_sha256", "n_bytes", "fp"])

    return run


def _parts(rows: DataFrame) -> DataFrame:
    """Rows with ``part`` and its number ``i`` in place of ``text``."""
    last = F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / PART).cast("int")
    split = rows.withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    return split.withColumn("part", F.substring("text", F.col("i") * PART + 1, F.lit(PART))).drop("text")


def _huge_prints(huge: DataFrame, bits: int) -> DataFrame:
    """``text_sha256, n_bytes, fp`` of huge texts; parts go to tasks of their own, equal texts' once."""
    parts = _parts(huge.select("text", "text_sha256", "n_bytes")).repartition("text_sha256", "i")
    made = parts.mapInArrow(_part_values, "text_sha256 string, n_bytes long, i int, v0 long, v1 long, n long")
    text = ["text_sha256", "n_bytes"]
    once = made.groupBy(*text, "i").agg(*[F.first(c).alias(c) for c in ("v0", "v1", "n")])
    whole = once.groupBy(*text).agg(F.array_sort(F.collect_list(F.struct("i", "v0", "v1", "n"))).alias("parts"))
    return stored(whole.mapInArrow(_combined(bits), "text_sha256 string, n_bytes long, fp long"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 62, huge_bytes: int = HUGE) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Of equal texts the largest doc_id stays; null texts count as empty, so they equal empty ones.
    Rows with a null id take part and stay only if no row of the group has an id. Rows that repeat
    an id and a text count twice in group_size and are both marked as kept. An empty table gives
    an empty result; further columns are ignored, whatever their names. Texts of more than
    ``huge_bytes`` are hashed and compared in parts.
    """
    text = F.coalesce(column(text_col).cast("string"), F.lit("")).cast("binary")
    source = docs.select(column(id_col).alias("doc_id"), text.alias("text")).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
    own = f"doc_id {source.schema['doc_id'].dataType.simpleString()}"
    small = source.where(F.col("n_bytes") <= huge_bytes).mapInArrow(_prints(bits), f"{own}, text binary, n_bytes long, text_sha256 string, fp long")
    prints, longest = small, docs.agg(F.max(F.octet_length(column(text_col).cast("string")))).first()[0] or 0
    if longest > huge_bytes:
        huge = source.where(F.col("n_bytes") > huge_bytes)
        prints = small.unionByName(huge.join(_huge_prints(huge, bits), ["text_sha256", "n_bytes"]))
    rows = stored(prints.drop("text"))
    key = ["fp", "n_bytes"]
    largest = F.max("doc_id").alias("keep_id")
    shared = rows.groupBy(*key).agg(F.count("*").alias("size"), largest, F.coalesce(F.max_by("text_sha256", "doc_id"), F.min("text_sha256")).alias("first"))
    shared = stored(shared.where("size > 1"))
    # representatives are copied for every PER_COPY members, and members dealt out among the copies
    copies = F.ceil(F.col("size") / PER_COPY).cast("int")
    # texts that share no fingerprint are not to be shuffled; fingerprints have 62 bits, bitmaps go by the highest of 64
    bitmap = broadcast_bitmap(shared.select(F.shiftleft("fp", 2).alias("high")), "high")
    wide = prints.mapInArrow(_maybe_shared(bitmap), prints.schema).join(shared, key).withColumn("salt", F.pmod(F.xxhash64("doc_id"), copies).cast("int"))
    wide = stored(_parts(wide))
    best = wide.where(F.col("text_sha256") == F.col("first")).select(*key, "i", F.col("part").alias("other"), copies.alias("copies")).dropDuplicates([*key, "i"])
    best = stored(best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies"))
    judged = wide.join(best, [*key, "i", "salt"])
    mixed = stored(judged.where("part <> other").select(*key).distinct())
    groups = shared.drop("first").join(mixed, key, "left_anti")
    plain = rows.join(mixed, key, "left_anti").join(groups, key, "left")
    out = plain.select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
    if not mixed.isEmpty():
        # a fingerprint of several texts: by the text itself, a huge one by its digest
        same = F.when(F.col("n_bytes") <= PART, F.col("part")).otherwise(F.unhex("text_sha256"))
        odd = stored(wide.where("i = 0").join(mixed, key, "left_semi").select("doc_id", same.alias("same"), "n_bytes", "text_sha256"))
        own = odd.groupBy("same", "n_bytes").agg(F.count("*").alias("group_size"), largest)
        out = out.union(odd.join(own, ["same", "n_bytes"]).select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
