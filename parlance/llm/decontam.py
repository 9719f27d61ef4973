"""Benchmark decontamination: find windows of benchmark words in training text, remove or report.

The benchmark's windows (13 words, or a whole item of fewer) are held as a hash set that is
broadcast while it is small; ``max_broadcast_bytes`` bounds it by the benchmark's text. A larger
benchmark is joined instead: only windows of documents whose hash is in a broadcast bitmap of the
items' hashes are shuffled, and they meet the items' by their words. Both ways verify a hit word by
word, and give the same rows; an item is what has one id, in however many rows its texts come.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import kept_columns, pack, row_with, stored
from parlance.llm.hashing import VALUES, broadcast_bitmap, digest, each_bytes, hit, longs, range_hashes, word_bounds

WINDOW = 13
PIECE = 1 << 22
#: Bytes of words: digits, lower-case letters and all of UTF-8 beyond ASCII; A-Z are folded, others separate.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _pieces(text: bytes):
    """Word lists of a text, cut between words so that memory follows the piece."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and FOLD[text[end]] != 32:
            end += 1
        yield words(text[at:end])
        at = end


class Windows:
    """Distinct windows of benchmark items by length, found by hash and compared word by word."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        owners: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for name, ws in items:
            n, ids = number[name], [self.vocabulary[w] for w in ws]
            k = min(WINDOW, len(ids))
            for i in range(len(ids) - k + 1) if k else ():
                owners.setdefault(k, {}).setdefault(tuple(ids[i : i + k]), set()).add(n)
        self.tables = []
        for k, found in sorted(owners.items()):
            grid = np.array(list(found), np.int64).reshape(-1, k)
            for seed in range(1, 1000):  # another multiplier until the hashes are distinct
                powers = self._powers(k, seed)
                hashes = (grid.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
                if len(np.unique(hashes)) == len(hashes):
                    break
            order = np.argsort(hashes)
            self.tables.append((k, powers, hashes[order], grid[order], [sorted(found[tuple(g)]) for g in grid[order].tolist()]))

    def plain(self) -> tuple:
        """Dicts, lists and arrays only, which executors without this package can read from a broadcast."""
        return self.vocabulary, self.names, self.tables

    @classmethod
    def of(cls, parts: tuple) -> Windows:
        made = cls.__new__(cls)
        made.vocabulary, made.names, made.tables = parts
        return made

    @staticmethod
    def _powers(k: int, seed: int) -> np.ndarray:
        out, x = [], 1
        for _ in range(k):
            x = x * (0x9E3779B97F4A7C15 + 2 * seed) % (1 << 64)
            out.append(x ^ x >> 31)
        return np.array(out, np.uint64)

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, which of them are hit, and the items whose windows occur."""
        parts = [np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int32, len(ws)) for ws in _pieces(text or b"")]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        edge, items = np.zeros(len(ids) + 1, np.int32), set()
        known = np.r_[0, np.cumsum(ids >= 0)]
        for k, powers, hashes, grid, owners in self.tables:
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            for block in np.split(at, range(1 << 16, len(at), 1 << 16)):
                if not len(block):
                    continue
                own = ids[block[:, None] + np.arange(k)]
                h = (own.astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64)
                j = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                ok = np.flatnonzero((hashes[j] == h) & (grid[j] == own).all(axis=1))
                np.add.at(edge, block[ok], 1)
                np.add.at(edge, block[ok] + k, -1)
                for x in np.unique(j[ok]).tolist():
                    items.update(owners[x])
        return len(ids), np.cumsum(edge[:-1]) > 0, items


def items_digest(names) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _scanner(shared):
    def run(batches):
        index = Windows.of(shared.value)
        for batch in batches:
            out = []
            for t in batch.column(1).cast(pa.binary()):
                n, hit, items = index.scan(t.as_py())
                n_hit = int(hit.sum())
                out.append((n, n_hit, len(items), items_digest(index.names[i] for i in items), is_contaminated(n_hit, n)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


WINDOW_ROW = "k int, h long, words binary"


def _window_hashes(folded: bytes, k: int, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hashes of all windows of ``k`` words of a folded text."""
    start, end = bounds
    if len(start) < k:
        return np.zeros(0, np.int64)
    at = np.arange(len(start) - k + 1)
    return range_hashes(range_hashes(VALUES[np.frombuffer(folded, np.uint8)], start, end), at, at + k).view(np.int64)


def _bounds(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    return word_bounds(np.frombuffer(folded, np.uint8) == 32)


def _item_windows(batches):
    for batch in batches:
        for i, text in enumerate(each_bytes(batch.column(1))):
            folded = b" ".join(words(text))
            start, end = bounds = _bounds(folded)
            k = min(WINDOW, len(start))
            h = _window_hashes(folded, k, bounds) if k else ()
            if len(h):
                texts = [folded[a:z] for a, z in zip(start.tolist(), end[k - 1 :].tolist(), strict=False)]
                name = pa.repeat(batch.column(0)[i], len(h))
                yield pa.RecordBatch.from_arrays([name, pa.array(np.full(len(h), k, np.int32)), pa.array(h), pa.array(texts, pa.binary())], names=["item_id", "k", "h", "words"])


def _parts(folded: bytes, overlap: int):
    """(number of the first word, part) of a folded text; parts overlap by ``overlap`` words."""
    at, number = 0, 0
    while at < len(folded):
        end, start = at, ()
        while end < len(folded) and len(start) <= 2 * overlap:
            end += PIECE
            while end < len(folded) and folded[end] != 32:
                end += 1
            start = _bounds(folded[at:end])[0]
        yield number, folded[at:end]
        if end >= len(folded):
            return
        step = len(start) - overlap
        number, at = number + step, at + int(start[step])


def _candidates(bitmap, lengths):
    """Windows of texts whose hashes are in the bitmap: (t1, t2, start, k, h, words)."""

    def run(batches):
        for batch in batches:
            for text in each_bytes(batch.column(0)):
                t1, t2 = longs([digest(text)])
                for number, part in _parts(text.translate(FOLD), WINDOW - 1):
                    start, end = bounds = _bounds(part)
                    for k in lengths:
                        h = _window_hashes(part, k, bounds)
                        at = np.flatnonzero(hit(bitmap.value, h)) if len(h) else ()
                        if not len(at):
                            continue
                        found = [b" ".join(part[start[i] : end[i + k - 1]].split()) for i in at.tolist()]
                        n = len(at)
                        cols = [np.repeat(t1, n), np.repeat(t2, n), at + number, np.full(n, k, np.int32), h[at]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(found, pa.binary())], names=["t1", "t2", "start", "k", "h", "words"])

    return run


def _sized(batches):
    """Rows with their texts, the texts' digests and numbers of words."""
    for batch in batches:
        texts = list(each_bytes(batch.column(1)))
        t1, t2 = longs([digest(t) for t in texts]) if texts else (np.zeros(0, np.int64),) * 2
        n = [sum(map(len, _pieces(t))) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t1), pa.array(t2), pa.array(n, pa.int64())], names=["row", "text", "t1", "t2", "n_words"])


def _joined_hits(texts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The way without a broadcast set, by the texts' digests: (t1, t2, ranges of hit words, n_hit) and (t1, t2, item_id)."""
    wins = stored(items.select("item_id", "text").mapInArrow(_item_windows, f"item_id string, {WINDOW_ROW}").distinct())
    key = ["k", "h", "words"]
    lengths = sorted(r["k"] for r in wins.select("k").distinct().collect())  # 13 at most
    found = texts.mapInArrow(_candidates(broadcast_bitmap(wins.select("h").distinct(), "h"), lengths), f"t1 long, t2 long, start long, {WINDOW_ROW}").distinct()
    hits = stored(found.join(wins.select(*key).distinct(), key, "left_semi"))
    # windows in order; one that starts beyond all ends before it begins a new range
    text = Window.partitionBy("t1", "t2").orderBy("start", "k")
    spans = hits.select("t1", "t2", "start", "k").distinct().withColumn("end", F.col("start") + F.col("k"))
    spans = spans.withColumn("before", F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("nth", F.count_if(F.col("before").isNull() | (F.col("start") > F.col("before"))).over(text))
    ranges = spans.groupBy("t1", "t2", "nth").agg(F.min("start").alias("a"), F.max("end").alias("z"))
    ranges = ranges.groupBy("t1", "t2").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("ranges"), F.sum(F.col("z") - F.col("a")).alias("n_hit"))
    return stored(ranges), hits.select("t1", "t2", *key).distinct().join(wins, key).select("t1", "t2", "item_id").distinct()


def _joined(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    packed = pack(docs, text_col)
    ranges, owners = _joined_hits(packed.select(F.coalesce("c0", F.lit("")).alias("text")), items)
    named = owners.groupBy("t1", "t2").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = stored(ranges.drop("ranges").join(named, ["t1", "t2"]))
    sized = packed.mapInArrow(_sized, row_with(packed, "text string, t1 long, t2 long, n_words long")).drop("text")
    hits = F.coalesce("n_hit", F.lit(0)).cast("long")
    n_items, names = F.coalesce(F.size("items"), F.lit(0)).cast("long"), F.coalesce(F.array_join("items", ","), F.lit(""))
    return sized.join(found, ["t1", "t2"], "left").select("row", "n_words", hits.alias("n_hit"), n_items.alias("n_items"), F.sha2(names, 256).alias("items_sha256"), ((hits > 0) & (20 * hits >= F.col("n_words"))).alias("contaminated"))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).alias("text"))


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _broadcast(items: DataFrame):
    """The hash set of a benchmark whose size has been checked."""
    index = Windows([(r["item_id"], words(r["text"].encode())) for r in items.distinct().collect()])
    return items.sparkSession.sparkContext.broadcast(index.plain())


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``row`` (the caller's columns), n_words, n_hit, n_items, items_sha256 and contaminated.

    A null or empty text has no words and is not contaminated; null or wordless items have no
    window; an item whose id is null counts under the empty name; rows of one id are one item.
    Repeated rows are judged alike; an empty benchmark contaminates nothing; an empty table gives
    an empty result. Very long texts are read whole; columns of the caller may have any name.
    """
    items = _items(benchmark, item_col, item_text)
    if _bytes(items) > max_broadcast_bytes:
        return _joined(docs, items, text_col)
    packed = pack(docs, text_col)
    return packed.mapInArrow(_scanner(_broadcast(items)), row_with(packed, RESULT))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id`` and the figures of :func:`scan_benchmark` for every row."""
    out = scan_benchmark(docs.select("doc_id", "text"), benchmark, **options)
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that are not contaminated, unchanged.

    Rows with a null, empty or wordless text stay; rows that repeat stay or go together; an empty
    benchmark leaves all rows, an empty table stays empty. Options as in :func:`scan_benchmark`.
    """
    return kept_columns(scan_benchmark(docs, benchmark, **options).where(~F.col("contaminated")), docs)


def _without(text: bytes, hits: np.ndarray) -> str:
    """A text without the words that are marked."""
    flat = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    # a word starts where the byte before separates; each byte of a word has the word's number
    number = np.cumsum(flat & ~np.r_[False, flat[:-1]]) - 1
    keep = np.ones(len(text), bool)
    keep[flat] = ~hits[number[flat]]
    return np.frombuffer(text, np.uint8)[keep].tobytes().decode()


def _cleaned(shared):
    def run(batches):
        index = Windows.of(shared.value)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1).cast(pa.binary())]
            out = [None if t is None else _without(t, index.scan(t)[1]) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "clean_text"])

    return run


def _cleaned_of_ranges(batches):
    for batch in batches:
        out = []
        for t, n, ranges in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("n_words").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            if t is not None and ranges:
                hits = np.zeros(n, bool)
                for r in ranges:
                    hits[r["a"] : r["z"]] = True
                t = _without(t, hits).encode()
            out.append(None if t is None else t.decode())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "clean_text"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``row`` and ``clean_text``: the text without its hit words (what separates them stays).

    A null text stays null, an empty one empty. Repeated rows are cleaned alike; an empty benchmark
    changes nothing; an empty table gives an empty result. A benchmark of more text than
    ``max_broadcast_bytes`` is joined instead of broadcast, with the same result.
    """
    items, packed = _items(benchmark, item_col, item_text), pack(docs, text_col)
    if _bytes(items) <= max_broadcast_bytes:
        return packed.mapInArrow(_cleaned(_broadcast(items)), row_with(packed, "clean_text string"))
    ranges, _ = _joined_hits(packed.select(F.coalesce("c0", F.lit("")).alias("text")), items)
    sized = packed.mapInArrow(_sized, row_with(packed, "text string, t1 long, t2 long, n_words long"))
    return sized.join(ranges.drop("n_hit"), ["t1", "t2"], "left").select("row", "text", "n_words", "ranges").mapInArrow(_cleaned_of_ranges, row_with(packed, "clean_text string"))
