"""Near-duplicates by SimHash fingerprints, found through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit in one of two
32-bit halves. So each distinct fingerprint is indexed under 64 keys: a half with one bit replaced
by a wildcard. Fingerprints that share a key are candidates and are verified with one XOR.

A bucket with more than ``max_bucket`` distinct fingerprints is never compared as a whole: its
members go on to narrower keys (the remaining bits are cut into four parts, of which one must be
equal), up to three times; after that a bucket can hold 2**15 distinct fingerprints at most. Within
a bucket only the links of a spanning chain per component are returned, never all pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import column, components, kept_columns, pack, row_field, row_with, stored
from parlance.llm.hashing import broadcast_bitmap, hit

SEED = 42
MAX_BITS = 3
#: Widths of the parts into which the bits that a bucket leaves free are cut, level by level.
PARTS = ((8, 8, 8, 8), (6, 6, 6, 6), (5, 5, 4, 4))
PIECE = 1 << 22


def _words(text: bytes, overlap: int):
    """Lists of lower-cased words, each starting with the last ``overlap`` words of the one before."""
    held: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
        held = held[-overlap:] if overlap else []
        held += text[at:end].lower().split()
        at = end
        yield held


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 values; 0 without words.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is the definition used here. Very
    long texts are cut into pieces that overlap, so memory follows the piece.
    """
    from xxhash import xxh64_intdigest

    if not text:
        return 0
    counts, total, first = np.zeros(64, np.int64), 0, []
    for words in _words(text, shingle - 1):
        n = len(words) - shingle + 1
        if n < 1:
            first = words
            continue
        first = []
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
        bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        # sums of up to 255 bits fit a byte
        counts += np.add.reduceat(bits, np.arange(0, n, 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += n
    if not total:
        if not first:
            return 0
        return xxh64_intdigest(b" ".join(first), SEED)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        fp = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["row", "fp"])


def with_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of the caller's columns) and ``fp`` (signed long) for every row."""
    packed = pack(docs, text_col)
    return packed.mapInArrow(_fingerprints, row_with(packed, "fp long"))


def _spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Chains that connect what is connected by links of MAX_BITS bits or fewer."""
    left, links = np.ones(len(fps), bool), []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        last, todo = start, [start]
        while todo:
            at = todo.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= MAX_BITS]
            left[near] = False
            for x in near.tolist():
                links.append((last, x))
                last = x
            todo += near.tolist()
    return links


def _compare(last_level: bool, max_bucket: int):
    """For rows (key, fp, rest) sorted by key: links, and members of buckets that are too large."""

    def run(batches):
        names = ["hot", "a", "b", "key", "rest"]
        key, fps, rests, size = None, [], [], 0

        def out(hot, a, b, k, r):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), *(pa.array(np.asarray(x, np.int64)) for x in (a, b, k, r))], names=names)

        def settle(m):
            pairs = _spanning(m.view(np.uint64))
            a, b = m[[x for x, _ in pairs]], m[[x for _, x in pairs]]
            return out(False, a, b, np.zeros(len(a)), np.zeros(len(a)))

        for batch in batches:
            k, f, r = (batch.column(i).to_numpy() for i in range(3))
            if not len(k):
                continue
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(k)]
            # the first run may go on from the batch before, the last may go on in the next
            two = (ends - starts == 2) & (starts > 0) & (ends < len(k))
            if two.any():
                a, b = f[starts[two]], f[starts[two] + 1]
                near = np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS
                if near.any():
                    yield out(False, a[near], b[near], np.zeros(near.sum()), np.zeros(near.sum()))
            long = np.flatnonzero((ends - starts > 2) | (starts == 0) | (ends == len(k)))
            for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                if k[s] != key:
                    if 1 < size <= max_bucket or last_level and size > 1:
                        yield settle(np.concatenate(fps))
                    key, fps, rests, size = k[s], [], [], 0
                fps.append(f[s:e])
                rests.append(r[s:e])
                size += e - s
                if size > max_bucket and not last_level:
                    m, q = np.concatenate(fps), np.concatenate(rests)
                    yield out(True, m, m, np.full(len(m), key), q)
                    fps, rests = [], []
        if 1 < size <= max_bucket or last_level and size > 1:
            yield settle(np.concatenate(fps))

    return run


def _wildcards(fp: Column) -> Column:
    """The 64 keys of a fingerprint with what each leaves free: array<struct<key, rest>>."""
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    out = []
    for half, (own, rest) in enumerate(((low, high), (high, low))):
        for bit in range(32):
            key = own.bitwiseAND(F.lit(0xFFFFFFFF ^ 1 << bit)).bitwiseOR(F.lit((half * 32 + bit) << 32))
            out.append(F.struct(key.alias("key"), rest.alias("rest")))
    return F.array(*out)


def _narrower(key: Column, rest: Column, widths: tuple[int, ...]) -> Column:
    out, at = [], 0
    for j, width in enumerate(widths):
        part = F.shiftright(rest, at).bitwiseAND(F.lit((1 << width) - 1))
        left = rest.bitwiseAND(F.lit((1 << at) - 1)).bitwiseOR(F.shiftleft(F.shiftright(rest, at + width), at))
        out.append(F.struct(F.xxhash64(key, F.lit(j), part).alias("key"), left.alias("rest")))
        at += width
    return F.array(*out)


def links(fps: DataFrame, max_bucket: int = 4096) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (one long column) whose closure is the
    closure of all links at MAX_BITS bits or fewer."""
    fp = fps.columns[0]
    keyed = fps.select(F.col(fp).alias("fp"), F.explode(_wildcards(F.col(fp))).alias("k")).select("k.key", "fp", "k.rest")
    found = None
    for level in range(len(PARTS) + 1):
        last = level == len(PARTS)
        shuffled = keyed.repartition("key").sortWithinPartitions("key")
        made = stored(shuffled.mapInArrow(_compare(last, max_bucket), "hot boolean, a long, b long, key long, rest long"))
        pairs = made.where("not hot").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        hot = made.where("hot")
        if last or hot.isEmpty():
            return found.distinct()
        sub = F.explode(_narrower(F.col("key"), F.col("rest"), PARTS[level]))
        keyed = hot.select(F.col("a").alias("fp"), sub.alias("k")).select("k.key", "fp", "k.rest")


def groups(rows: DataFrame, max_bucket: int = 4096) -> DataFrame:
    """From stored rows ``(doc_id, fp)``: one row per distinct fingerprint with ``component_id``
    (smallest doc_id of its component) and ``keep_fp`` (that document's fingerprint)."""
    own = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(own.select("fp"), max_bucket))
    rooted = stored(own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    best = F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "fp"))
    whole = stored(rooted.groupBy("root").agg(best.alias("best")))
    return stored(rooted.join(whole, "root").select("fp", F.col("best.first_id").alias("component_id"), F.col("best.fp").alias("keep_fp")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = 4096) -> DataFrame:
    """Fingerprint and component of every row: ``doc_id, fingerprint, component_id``.

    Null and empty texts, and texts of whitespace, have fingerprint zero and are linked like any
    other. Repeated rows come back as often as they came. Rows whose doc_id is null take part;
    component_id is null only if no row of the component has an id. Ties don't occur: the smallest
    id wins. An empty table gives an empty result; further columns are ignored.
    """
    rows = stored(with_fingerprints(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))).select("row.doc_id", "fp"))
    found = groups(rows, max_bucket)
    return rows.join(found, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marked(bitmap, held: bool):
    """Rows whose hash the bitmap holds, or those whose hash it does not."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(hit(bitmap.value, batch.column("h").to_numpy()) == held))

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = 4096) -> DataFrame:
    """The rows that stay, one of each component, with the caller's columns.

    The row with the smallest id stays (ids that are null come last); of rows that repeat an id
    and a fingerprint, any one. Null, empty and blank texts are one group, of which one row stays.
    An empty table stays empty; columns may have any name. Rows whose number a bitmap of those that
    go does not hold stay without a shuffle; the few others meet the exact numbers in a join.
    """
    whole = stored(with_fingerprints(docs, text_col).withColumn("rid", F.monotonically_increasing_id()))
    rows = whole.select(row_field(id_col).alias("doc_id"), "fp", "rid")
    keep = groups(rows, max_bucket).select(F.col("component_id").alias("k_id"), F.col("keep_fp").alias("k_fp")).distinct()
    kept = rows.join(keep, (rows.fp == keep.k_fp) & rows.doc_id.eqNullSafe(keep.k_id)).groupBy("fp", "doc_id").agg(F.min("rid").alias("rid"))
    gone = stored(rows.select("rid").join(kept.select("rid"), "rid", "left_anti"))
    bitmap = broadcast_bitmap(gone.select(F.xxhash64("rid").alias("h")), "h")
    marked = whole.select("row", "rid", F.xxhash64("rid").alias("h"))
    sure = marked.mapInArrow(_marked(bitmap, False), marked.schema)
    unsure = marked.mapInArrow(_marked(bitmap, True), marked.schema).join(gone, "rid", "left_anti")
    return kept_columns(sure.select("row").union(unsure.select("row")), docs)
