"""Removal of long repeated passages: breadth-first interval expansion on a Burrows-Wheeler transform.

Every string of ``length`` bytes is dealt to a class by the smallest hash among its ``SEED``-byte
substrings, so equal strings are in one class wherever they occur. Consecutive strings of one class
form a segment. Segments that recur as a whole, and classes with one segment, need no text (unless
that segment repeats itself). The segments of a class that differ are brought together, and within them the strings that recur are
found as suffixes whose longest common prefix with a neighbour has at least ``length`` bytes: a
Burrows-Wheeler transform's intervals are extended backwards, breadth first, which yields common
prefixes by increasing value and stops at ``length``; what is then undecided recurs.

Classes with more than CLASS segments (a passage in a large part of all documents, with other
surroundings each time) are dealt out again by narrower pieces, at last by single strings, so no
class is gathered in one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored
from parlance.llm.hashing import VALUES, broadcast_bitmap, digest, each_bytes, hit, longs, range_hashes, spread, word_bounds

LENGTH = 400
SEED = 32
#: Bytes of a block of texts.
BLOCK = 1 << 18
#: Segments of a class that one task compares at most.
CLASS = 512
#: Starts in a piece, for classes within a task and for those that are dealt out again.
WIDTH, NARROW = 64, 32
#: Bytes that one transform covers.
BATCH = 1 << 19
#: Rows that a task makes Python objects of at once.
ROWS = 1024
#: Words of a passage that documents share.
PASSAGE = 51


def most_width(length: int) -> int:
    """Starts in a piece, so that what all their strings have in common is longer than a seed."""
    if length <= SEED:
        raise ValueError(f"length must be more than {SEED}")
    return max(1, (length - SEED) // 2)


def _seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes at each position."""
    h, size, mul = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < SEED:
        h = h[:-size] * np.uint64(mul) + h[size:]
        size, mul = 2 * size, mul * mul % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_minima(h: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive values, by windows that double."""
    n, size = len(h) - span + 1, 1
    low = h
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[span - size : span - size + n])


def blocks(texts: list[bytes], length: int):
    """Texts joined by 0xFF, BLOCK bytes at a time, with what they hold: (data, number of the first
    text, each text's offset, each text's number of strings, offset of the data in its text).

    Short texts share a block, so arrays are neither tiny nor larger than caches; a long text is
    cut into blocks that overlap by ``length`` - 1 bytes.
    """
    at = 0
    while at < len(texts):
        if len(texts[at]) > BLOCK:
            text = texts[at]
            for base in range(0, len(text) - length + 1, BLOCK):
                part = text[base : base + BLOCK + length - 1]
                yield part, at, np.zeros(1, np.int64), np.array([len(part) - length + 1]), base
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= BLOCK:
            size += len(texts[end]) + 1
            end += 1
        sizes = np.fromiter(map(len, texts[at:end]), np.int64, end - at)
        yield b"\xff".join(texts[at:end]), at, np.cumsum(sizes + 1) - sizes - 1, np.maximum(0, sizes - length + 1), 0
        at = end


@dataclass
class Segments:
    """Segments of one block: their text's number, class, offset in the block, number of strings,
    whether strings in one may be equal, least seed hash; and the block's seed hashes."""

    owner: np.ndarray
    h: np.ndarray
    start: np.ndarray
    n: np.ndarray
    own: np.ndarray
    low: np.ndarray
    seeds: np.ndarray

    def some(self, on: np.ndarray) -> Segments:
        return Segments(self.owner[on], self.h[on], self.start[on], self.n[on], self.own[on], self.low[on], self.seeds)

    def seed(self, i: int, span: int) -> int:
        """Offset of a segment's first seed."""
        s = int(self.start[i])
        return int((self.seeds[s : s + span] == self.low[i]).argmax())


def segments(data: bytes, first: np.ndarray, count: np.ndarray, length: int = LENGTH) -> Segments:
    """Segments of the texts in a block; ``first`` and ``count`` as :func:`blocks` gives them."""
    span, n = length - SEED + 1, len(data) - length + 1
    if n < 1 or not count.any():
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, np.zeros(0, bool), none, none)
    h = _seed_hashes(np.frombuffer(data, np.uint8))
    low = window_minima(h, span)
    edge = np.ones(n, bool)
    np.not_equal(low[1:], low[:-1], out=edge[1:])
    # two strings that have different first seeds may be equal, even in one segment
    turns = np.flatnonzero((h[: n - 1] == low[:-1]) & ~edge[1:]) + 1
    some, stop = first[count > 0], (first + count)[count > 0]
    edge[some] = True
    edge[stop[stop < n]] = True
    starts = np.flatnonzero(edge)
    runs = np.diff(np.r_[starts, n])
    owner = np.searchsorted(first, starts, "right") - 1
    keep = starts - first[owner] < count[owner]
    owner, starts, runs = owner[keep], starts[keep], runs[keep]
    parts = -(-runs // span)
    if parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(starts + runs, parts)
        owner, starts = np.repeat(owner, parts), np.repeat(starts, parts) + nth * span
        runs = np.minimum(span, ends - starts)
    own = np.searchsorted(turns, starts + runs) - np.searchsorted(turns, starts, "right") > 0
    return Segments(owner, spread(low[starts]).view(np.int64), starts, runs, own, low[starts], h)


def _segment_rows(length, classes=None, contents=None, with_bytes=False):
    """Segments of each text; with bitmaps, those whose class and content are in them."""

    def run(batches):
        for batch in batches:
            texts = list(each_bytes(batch.column(0)))
            digests = longs([digest(t) for t in texts]) if texts and not with_bytes else None
            for data, number, first, count, base in blocks(texts, length):
                found = segments(data, first, count, length)
                if classes is not None and len(found.h):
                    found = found.some(hit(classes.value, found.h))
                if not len(found.h):
                    continue
                bounds = list(zip(found.start.tolist(), (found.start + found.n + length - 1).tolist(), strict=True))
                c1, c2 = longs([digest(data[s:e]) for s, e in bounds])
                if contents is not None:
                    on = np.flatnonzero(hit(contents.value, c1))
                    if not len(on):
                        continue
                    found, c1, c2, bounds = found.some(on), c1[on], c2[on], [bounds[i] for i in on.tolist()]
                if with_bytes:
                    q = [found.seed(i, length - SEED + 1) for i in range(len(c1))]
                    cols = [found.h, c1, c2, found.n.astype(np.int32), np.array(q, np.int32), pa.array([data[s:e] for s, e in bounds], pa.binary())]
                    names = ["h", "c1", "c2", "n", "q", "data"]
                else:
                    t1, t2 = (x[number + found.owner] for x in digests)
                    cols = [found.h, c1, c2, found.n.astype(np.int32), t1, t2, found.start - first[found.owner] + base, found.own]
                    names = ["h", "c1", "c2", "n", "t1", "t2", "start", "own"]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=names)

    return run


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``symbols`` (values under 512, the last one smallest) in the order of their first ``depth`` symbols."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key << 9 | padded[j : j + n]
    known = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum(ranked[1:] != ranked[:-1])]
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        far = np.concatenate([rank + 1, np.zeros(2 * known, np.int64)])
        key = rank << 42 | far[known : known + n] << 21 | far[2 * known : 2 * known + n]
        known *= 3


def recurring(texts: list[bytes], length: int) -> np.ndarray:
    """For each position of the texts joined by one byte: does its string of ``length`` bytes start elsewhere, too?

    Texts hold UTF-8, so 0xFF separates them and no string with it recurs together with one without.
    """
    symbols = np.concatenate([np.frombuffer(b"\xff".join(texts), np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)])
    n = len(symbols)
    order = suffix_order(symbols, length)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # to the suffix that is one symbol longer
    step[by_symbol] = np.arange(n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    decided = np.zeros(n + 1, bool)
    decided[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(low - ends + size, size)
        # the first and the last of each symbol in an interval bound the interval of the longer string;
        # these don't overlap, so both ends in rising order belong together
        first = np.sort(step[at[before[at] < np.repeat(low, size)]])
        last = np.sort(step[at[after[at] >= np.repeat(high, size)]]) + 1
        new = ~decided[last]
        low, high = first[new], last[new]
        if not len(low):
            break
        decided[high] = True
    more = ~decided
    out = np.zeros(n, bool)
    out[order[more[:-1] | more[1:]]] = True
    return out[:-1]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


FOUND = "c1 long, c2 long, low int, high int"


def _found(rows):
    c1, c2, low, high = zip(*rows, strict=True) if rows else ((), (), (), ())
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((c1, c2, low, high), kinds, strict=True)], names=["c1", "c2", "low", "high"])


def _pieces(data: bytes, n: int, q: int, width: int, length: int):
    """Pieces of a segment: (first start, end of starts, shared core, whole).

    ``q`` is the offset of the first seed. A string's block and core depend on how far its first
    seed is from its start, and on nothing outside the string; a segment may hold a block in part.
    """
    seed, low = data[q : q + SEED], 0
    while low < n:
        if low > q:
            q = data.find(seed, low)
        stop = min(q, n - 1) + 1
        while low < stop:
            latest = q - (q - low) // width * width
            high = min(stop, latest + 1)
            yield low, high, data[latest : latest - width + 1 + length], data[low : high + length - 1]
            low = high


def _compare(length):
    """For the segments of whole classes, sorted by class: the starts whose strings recur."""

    def prepare(members, batch, rows):
        # pieces whose core is theirs alone can't recur; pieces that recur as a whole need no more
        cores: dict[bytes, list] = {}
        for c, n, q, data in members:
            for low, high, core, whole in _pieces(data, n, q, min(WIDTH, most_width(length)), length):
                cores.setdefault(digest(core), []).append((c, low, high, whole))
        for same in cores.values():
            if len(same) < 2:
                continue
            wholes: dict[bytes, list] = {}
            for c, low, high, whole in same:
                wholes.setdefault(whole, []).append((c, low, high))
            for owners in wholes.values():
                if len(owners) > 1:
                    rows += [(*c, low, high) for c, low, high in owners]
            if len(wholes) > 1:
                batch += [(owners[0] if len(owners) == 1 else None, whole) for whole, owners in wholes.items()]

    def settle(batch, rows):
        flags, at = recurring([whole for _, whole in batch], length), 0
        for owner, whole in batch:
            if owner:
                c, low, high = owner
                rows += [(*c, low + a, low + b) for a, b in _ranges(flags[at : at + high - low])]
            at += len(whole) + 1

    def run(batches):
        members, h, batch, rows, size = [], None, [], [], 0
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            for key, c1, c2, n, q, data in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if key != h:
                    held = len(batch)
                    prepare(members, batch, rows)
                    size += sum(len(w) + 1 for _, w in batch[held:])
                    if size > BATCH:
                        settle(batch, rows)
                        batch, size = [], 0
                    if len(rows) > 10_000:
                        yield _found(rows)
                        rows = []
                    members, h = [], key
                members.append(((c1, c2), n, q, data))
        prepare(members, batch, rows)
        if batch:
            settle(batch, rows)
        yield _found(rows)

    return run


def _split(width, length):
    """(c1, c2, low, n, q, data) into pieces: (core, whole, c1, c2, low, n, q, data)."""

    names = ["core", "whole", "c1", "c2", "low", "n", "q", "data"]
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def flush(out):
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches):
        out = []
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                for c1, c2, base, n, q, data in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                    for low, high, core, whole in _pieces(data, n, q, width, length):
                        out.append((digest(core), digest(whole), c1, c2, base + low, high - low, max(0, data.find(data[q : q + SEED], low) - low), whole))
                    if len(out) >= ROWS:
                        yield flush(out)
                        out = []
        yield flush(out)

    return run


def _large_classes(hot: DataFrame, length: int) -> DataFrame:
    """Recurring starts in classes too large for one task: by narrow pieces, then string by string."""
    kind = "core binary, whole binary, c1 long, c2 long, low int, n int, q int, data binary"
    rest, found = hot.select("c1", "c2", F.lit(0).alias("low"), "n", "q", "data"), None
    for width in sorted({min(NARROW, most_width(length)), 1}, reverse=True):
        made = stored(rest.mapInArrow(_split(width, length), kind))
        counts = stored(made.groupBy("core", "whole").agg(F.count("*").alias("m")))
        again = made.join(counts.where("m > 1").select("whole"), "whole", "left_semi").select("c1", "c2", "low", (F.col("low") + F.col("n")).alias("high"))
        found = again if found is None else found.union(again)
        if width > 1:
            # a core with several wholes; one copy of each whole stands for all
            mixed = stored(counts.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core"))
            rest = made.join(mixed, "core", "left_semi").dropDuplicates(["core", "whole"]).select("c1", "c2", "low", "n", "q", "data")
    return found


def repeated(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """From one binary column: ``t1, t2`` (digest of a text) and ``spans``, the byte ranges that recurring strings cover."""
    kind = "h long, c1 long, c2 long, n int, t1 long, t2 long, start long, own boolean"
    made = texts.mapInArrow(_segment_rows(length), kind)
    own = stored(made.groupBy("h", "c1", "c2").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.min(F.struct("t1", "t2", "start")).alias("at"), F.bool_or("own").alias("own")))
    several = stored(own.groupBy("h").agg(F.count("*").alias("k"), F.bool_or("own").alias("own")).where("k > 1 OR own").select("h", "k"))
    near = broadcast_bitmap(several, "h")

    def in_several(batches):
        for b in batches:
            yield b.filter(pa.array(hit(near.value, b.column(0).to_numpy())))

    mixed = own.select("h", "c1", "c2", "m", "n", F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2")).mapInArrow(in_several, "h long, c1 long, c2 long, m long, n int, t1 long, t2 long")
    mixed = stored(mixed.join(several, "h"))
    # the text of one copy of each segment
    data = texts.mapInArrow(_segment_rows(length, near, broadcast_bitmap(mixed, "c1"), True), "h long, c1 long, c2 long, n int, q int, data binary").dropDuplicates(["c1", "c2"])
    data = stored(data.join(mixed.select("c1", "c2", "k"), ["c1", "c2"]).select("h", "c1", "c2", "n", "q", "data", "k"))
    small = data.where(F.col("k") <= CLASS).select("h", "c1", "c2", "n", "q", "data")
    part = small.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(length), FOUND)
    whole = own.where("m > 1").select("c1", "c2", F.lit(0).alias("low"), F.col("n").alias("high"))
    found = part.union(whole)
    hot = data.where(F.col("k") > CLASS)
    if not hot.isEmpty():
        found = found.union(_large_classes(hot, length))
    found = stored(found.groupBy("c1", "c2").agg(F.collect_set(F.struct("low", "high")).alias("ranges")))
    classes = own.join(found.select("c1", "c2"), ["c1", "c2"], "left_semi").select("h").distinct()
    where = texts.mapInArrow(_segment_rows(length, broadcast_bitmap(classes, "h"), broadcast_bitmap(found, "c1")), kind).select("c1", "c2", "t1", "t2", "start").dropDuplicates()
    spans = where.join(found, ["c1", "c2"]).select("t1", "t2", F.transform("ranges", lambda r: F.struct((F.col("start") + r["low"]).alias("low"), (F.col("start") + r["high"] + length - 1).alias("high"))).alias("s"))
    return stored(spans.groupBy("t1", "t2").agg(F.flatten(F.collect_list("s")).alias("spans")))


#: What parts words, with what parts texts in a block.
_PARTS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32, 255])


def word_windows(data: bytes, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``size`` words in the texts that start at ``first``: (text, window's hash, least hash of its halves).

    Windows that follow each other mostly have the same least hash, equal windows always have.
    """
    x = np.frombuffer(data, np.uint8)
    start, end = word_bounds(_PARTS[x])
    half = size // 2 + 1
    if len(start) < size:
        return (np.zeros(0, np.int64),) * 3
    words = range_hashes(VALUES[x], start, end)
    at = np.arange(len(words) + 1)
    whole = range_hashes(words, at[: -size], at[size:])
    low = window_minima(range_hashes(words, at[:-half], at[half:]), size - half + 1)
    begin = np.searchsorted(start, first)
    last = np.r_[begin[1:], len(start)]
    owner = np.searchsorted(begin, at[: -size], "right") - 1
    inside = at[: -size] + size <= last[owner]
    return owner[inside], whole[inside].view(np.int64), spread(low[inside]).view(np.int64)


def _word_blocks(texts: list[bytes], size: int):
    """(data, number of the first text, offsets of the texts); long texts in parts that overlap by ``size`` - 1 words."""
    for data, number, first, _, base in blocks([t if len(t) <= BLOCK else b"" for t in texts], 1):
        if base == 0:
            yield data, number, first
    for number, text in enumerate(texts):
        at = 0 if len(text) > BLOCK else len(text)
        while at < len(text):
            end, words = at, []
            while end < len(text) and len(words) < 2 * size:
                end += BLOCK
                while end < len(text) and not _PARTS[text[end]]:
                    end += 1
                words = text[at:end].split()
            yield text[at:end], number, np.zeros(1, np.int64)
            # the next part starts with the last words of this one
            back, seen = end, 0
            while end < len(text) and seen < size:
                back -= 1
                seen += not _PARTS[text[back]] and _PARTS[text[back - 1]]
            at = back if end < len(text) else len(text)


def _passage_rows(size, shared=None):
    """Distinct least hashes of each text's windows; with a bitmap of those, the windows that have one in it."""

    def run(batches):
        for batch in batches:
            texts = list(each_bytes(batch.column(0)))
            own = longs([digest(t) for t in texts])[0] if texts else None
            for data, number, first in _word_blocks(texts, size):
                owner, whole, low = word_windows(data, first, size)
                if shared is None:
                    new = np.ones(len(low), bool)
                    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
                    owner, value = owner[new], low[new]
                else:
                    on = hit(shared.value, low)
                    owner, value = owner[on], whole[on]
                if len(owner):
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(own[number + owner])], names=["w", "t1"])

    return run


def shared_passages(texts: DataFrame, size: int = PASSAGE) -> DataFrame:
    """``t1, t2`` (digest) of the texts with ``size`` words in a row that another row's text has, too.

    What parts words doesn't count. Windows meet by their hash of 64 bits, and so do texts there, but
    only windows whose halves' least hash occurs in several texts, so most are never shuffled.
    """
    def in_several(rows: DataFrame) -> DataFrame:
        return rows.groupBy("w").agg(F.min("t1").alias("a"), F.max("t1").alias("z")).where("a <> z").select("w")

    def long(batches):
        for batch in batches:
            some = [t for t in each_bytes(batch.column(0)) if len(t) >= 2 * size - 1 and len(t.split()) >= size]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in longs([digest(t) for t in some])], names=["t1", "t2"])

    lows = stored(in_several(texts.mapInArrow(_passage_rows(size), "w long, t1 long")))
    rows = stored(texts.mapInArrow(_passage_rows(size, broadcast_bitmap(lows, "w")), "w long, t1 long").distinct())
    mixed = rows.join(in_several(rows), "w", "left_semi").select("t1", F.lit(True).alias("mixed")).distinct()
    whole = texts.mapInArrow(long, "t1 long, t2 long").groupBy("t1", "t2").agg(F.count("*").alias("m"))
    return stored(whole.join(mixed, "t1", "left").where("m > 1 OR mixed").select("t1", "t2"))


def _texts(bitmap):
    """Rows with their digests; the text itself only where something may have to be removed."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), list(each_bytes(b.column(1)))
            t1, t2 = longs([digest(t) for t in texts]) if texts else (np.zeros(0, np.int64),) * 2
            on = hit(bitmap.value, t1) if texts else []
            rows = [ids, pa.array(t1), pa.array(t2), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t if x else None for t, x in zip(texts, on, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "t1", "t2", "n_bytes", "sha", "text"])

    return run


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What remains of a text and the maximal runs that go."""
    runs: list[list[int]] = []
    for low, high in sorted(spans):
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high)
        else:
            runs.append([low, high])
    kept, at = [], 0
    for low, high in runs:
        kept.append(text[at:low])
        at = high
    return b"".join([*kept, text[at:]]), [tuple(r) for r in runs]


def _cut_rows(batches):
    for b in batches:
        text, removed, n, sha = [], [], [], []
        for t, s, spans in zip(b.column("text").to_pylist(), b.column("sha").to_pylist(), b.column("spans").to_pylist(), strict=True):
            if not spans:
                text.append(None)
                removed.append(0)
                n.append(0)
                sha.append(s)
                continue
            kept, runs = cut(t, [(x["low"], x["high"]) for x in spans])
            text.append(kept)
            removed.append(len(t) - len(kept))
            n.append(len(runs))
            sha.append(hashlib.sha256(kept).hexdigest())
        cols = [b.column("doc_id"), b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), b.column("shares_passage"), pa.array(text, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage, kept`` for every row.

    ``kept`` holds the remaining bytes where something was removed and is null where the text stays
    as it is. ``shares_passage`` tells of passages by words, not bytes: whether ``passage`` words in
    a row also stand in another row. A null text counts as empty. Texts shorter than ``length``
    bytes stay. Repeated rows recur in each other, so they lose all that is long enough; ids may be
    null or repeat. An empty table gives an empty result; further columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    spans = repeated(source.select("text"), length)
    key = source.schema["doc_id"].dataType.simpleString()
    rows = source.mapInArrow(_texts(broadcast_bitmap(spans, "t1")), f"doc_id {key}, t1 long, t2 long, n_bytes long, sha string, text binary")
    shared = shared_passages(source.select("text"), passage).withColumn("shares_passage", F.lit(True))
    marks = stored(spans.join(shared, ["t1", "t2"], "full_outer"))
    joined = rows.join(marks, ["t1", "t2"], "left").select("doc_id", "n_bytes", "sha", "text", "spans", F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"))
    return joined.mapInArrow(_cut_rows, f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean, kept binary")
