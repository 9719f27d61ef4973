"""Ranked search over dual-sorted wavelet trees, one for each shard of documents.

The postings of a shard lie in one sequence: term after term, each term's documents by falling impact. A wavelet
matrix over that sequence splits it by the bits of the documents' numbers, so a term's range can be followed down
to any run of documents, and within every run it still is in order of impact: its first entry is the largest that
the run has to offer. A query holds a node (a run of documents) with the ranges of its terms; the sum of weight
times first impact bounds the score of every document below. The best nodes are opened first, and what can't beat
the k-th best document so far is never opened. At a leaf the bound is the document's score, so the result is exact.

Shards are built where their documents are read, so texts are never shuffled; they are written once and can be
searched by any number of queries. A task that searches several shards carries its best documents from one to the
next. Queries are sent to the shards in blocks of bounded size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from parlance.llm.common import column, stored

#: Postings after which a shard is closed, bytes of text that are cut up at once, bytes of a stored piece.
POSTINGS, PIECE, STORED = 1 << 20, 1 << 22, 1 << 20
#: Nodes that a query opens at once.
WAVE = 32
#: Bytes of queries that are sent to the shards at once.
QUERY_BYTES = 1 << 24
#: Impacts are below this; an id that is null counts as the largest.
IMPACT_BITS, NO_ID = 20, (1 << 63) - 1
NOT_TERMS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TABLE = bytes(x if chr(x).isalnum() and x < 128 or x > 127 else 32 for x in range(256)).lower()


def terms_of(text: bytes | None):
    """Lists of a text's terms, in order; long texts come in several."""
    at, plain = 0, (text or b"").translate(TABLE)
    while at < len(plain):
        end = len(plain) if at + PIECE >= len(plain) else plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _lengths(batches):
    for batch in batches:
        n = [sum(map(len, terms_of(t.as_py()))) for t in batch.column(0).cast(pa.binary())]
        yield pa.RecordBatch.from_pydict({"docs": pa.array([sum(x > 0 for x in n)], pa.int64()), "terms": pa.array([sum(n)], pa.int64())})


@dataclass
class Index:
    """Tables of an index: ``pieces`` (shard, name, level, piece, data), ``vocabulary`` (term, df), and the counts of documents and terms."""

    pieces: DataFrame
    vocabulary: DataFrame
    docs: int
    terms: int


class _Growing:
    """Documents of a shard that isn't closed yet."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.ids, self.n, self.sizes, self.term, self.tf, self.postings = [], [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        got, n = Counter(), 0
        for words in terms_of(text):
            got.update(words)
            n += len(words)
        if n:
            self.ids.append(NO_ID if doc_id is None else doc_id)
            self.n.append(n)
            self.sizes.append(len(got))
            self.term.append(np.fromiter(map(self.vocabulary.__getitem__, got), np.int64, len(got)))
            self.tf.append(np.fromiter(got.values(), np.int64, len(got)))
            self.postings += len(got)

    def closed(self, docs: int, terms: int):
        """The shard as (name, level, data), and how many documents each term has."""
        ids, n = np.array(self.ids, np.int64), np.array(self.n, np.int64)
        order = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        m = 100 - 90 + (90 * n * docs) // terms
        term, tf = np.concatenate(self.term), np.concatenate(self.tf)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, self.sizes))
        doc, bits = np.repeat(number, self.sizes), len(ids).bit_length()
        if bits + IMPACT_BITS + len(self.vocabulary).bit_length() < 64:
            # one number orders by term, falling impact and document
            top = (1 << IMPACT_BITS) - 1
            keys = np.sort((term << IMPACT_BITS | top - impact) << bits | doc)
            doc, impact = keys & (1 << bits) - 1, top - (keys >> bits & top)
        else:
            by = np.lexsort((doc, -impact, term))
            doc, impact = doc[by], impact[by]
        df = np.bincount(term, minlength=len(self.vocabulary))
        yield "terms", 0, b" ".join(self.vocabulary)
        yield "offsets", 0, np.r_[0, np.cumsum(df)].astype(np.int64).tobytes()
        yield "ids", 0, ids[order].tobytes()
        yield "impacts", 0, impact.astype(np.int32).tobytes()
        for level, shift in enumerate(reversed(range(max(1, (len(ids) - 1).bit_length())))):
            one = (doc >> shift & 1).astype(bool)
            yield "bits", level, np.packbits(one, bitorder="little").tobytes()
            doc = np.concatenate([doc[~one], doc[one]])
        yield "df", 0, df


PIECES = "shard long, name string, level int, piece int, data binary, term string, df long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64())
    names = [f.split()[0] for f in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _builder(docs: int, terms: int, postings: int):
    def run(batches):
        from pyspark import TaskContext

        shard, growing = TaskContext.get().partitionId() << 32, _Growing()

        def close():
            for name, level, data in growing.closed(docs, terms):
                if name == "df":
                    words = [w.decode() for w in growing.vocabulary]
                    for s in range(0, len(words), 1 << 16):
                        part = words[s : s + (1 << 16)]
                        none = [None] * len(part)
                        yield _batch(list(zip([shard] * len(part), ["df"] * len(part), none, none, none, part, data[s : s + len(part)].tolist(), strict=True)))
                else:
                    for i, s in enumerate(range(0, len(data), STORED)):
                        yield _batch([(shard, name, level, i, data[s : s + STORED], None, None)])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                growing.add(doc_id, text.as_py())
                if growing.postings >= postings:
                    yield from close()
                    shard, growing = shard + 1, _Growing()
        if growing.postings:
            yield from close()

    return run


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", postings: int = POSTINGS) -> Index:
    """Index every document with a term. Ids are whole numbers; null ids count as the largest.

    Texts are read twice: the impact of a term depends on the mean length of all documents.
    """
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    got = rows.select("text").mapInArrow(_lengths, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n, total = got[0] or 0, got[1] or 0
    made = stored(rows.mapInArrow(_builder(n, total, postings), PIECES))
    vocabulary = stored(made.where("name = 'df'").groupBy("term").agg(F.sum("df").alias("df")))
    return Index(made.where("name <> 'df'").drop("term", "df"), vocabulary, n, total)


class Shard:
    """A wavelet matrix over postings, with the impacts in the order of each level."""

    def __init__(self, pieces: dict[tuple[str, int], bytes]):
        self.lookup = {t: i for i, t in enumerate(pieces["terms", 0].split(b" "))}
        self.offsets = np.frombuffer(pieces["offsets", 0], np.int64)
        self.ids = np.frombuffer(pieces["ids", 0], np.int64)
        impacts = np.frombuffer(pieces["impacts", 0], np.int32)
        size, self.levels = len(impacts), sum(name == "bits" for name, _ in pieces)
        width = size // 64 + 1
        self.words = np.zeros((self.levels, width), np.uint64)
        self.before = np.zeros((self.levels, width), np.int64)
        self.zeros = np.zeros(self.levels, np.int64)
        self.impacts = [impacts]
        for level in range(self.levels):
            packed = np.frombuffer(pieces["bits", level], np.uint8)
            self.words[level].view(np.uint8)[: len(packed)] = packed
            ones = np.cumsum(np.bitwise_count(self.words[level]), dtype=np.int64)
            self.before[level, 1:] = ones[:-1]
            self.zeros[level] = size - ones[-1]
            one = np.unpackbits(packed, count=size, bitorder="little").astype(bool)
            self.impacts.append(np.concatenate([self.impacts[-1][~one], self.impacts[-1][one]]))

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits of a level before a place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level, word] + np.bitwise_count(self.words[level, word] & mask).astype(np.int64)

    def range_of(self, term: bytes) -> tuple[int, int]:
        i = self.lookup.get(term)
        return (0, 0) if i is None else (int(self.offsets[i]), int(self.offsets[i + 1]))


def best_first(shard: Shard, terms: list[bytes], weights: list[int], k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ``k`` best (score, doc_id) of a shard and of ``best``, highest first, equal scores by id."""
    found = [(*shard.range_of(t), w) for t, w in zip(terms, weights, strict=True) if w > 0]
    found = [x for x in found if x[1] > x[0]]
    if not found:
        return best
    s, e, w = (np.array(x, np.int64) for x in zip(*found, strict=True))
    top = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
    # nodes: level, first document's number, bound; where their ranges begin and how many they have
    level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound, start, size = np.array([(w * shard.impacts[0][s]).sum()]), np.zeros(1, np.int64), np.array([len(s)])
    while len(bound):
        score, doc = top[-1] if len(top) == k else (0, -(1 << 63))
        alive = (bound > score) | (bound == score) & (shard.ids[first] < doc)
        if not alive.all():
            level, first, bound, start, size = (x[alive] for x in (level, first, bound, start, size))
        if not len(bound):
            break
        if len(bound) > WAVE:
            chosen = np.argpartition(-bound, WAVE)[:WAVE]
            kept = np.ones(len(bound), bool)
            kept[chosen] = False
        else:
            chosen, kept = np.arange(len(bound)), np.zeros(len(bound), bool)
        # the ranges of the chosen nodes, one after another
        sizes = size[chosen]
        owner = np.repeat(np.arange(len(chosen)), sizes)
        at = np.repeat(start[chosen] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        lv, rs, re, rw = level[chosen][owner], s[at], e[at], w[at]
        s1, e1 = shard.ones(lv, rs), shard.ones(lv, re)
        side = [(rs - s1, re - e1), (shard.zeros[lv] + s1, shard.zeros[lv] + e1)]
        shift = shard.levels - 1 - level[chosen]
        grown = [(level[kept], first[kept], bound[kept], start[kept], size[kept])]
        for bit, (cs, ce) in enumerate(side):
            held = ce > cs
            if not held.any():
                continue
            cs, ce, cw, co, cl = cs[held], ce[held], rw[held], owner[held], lv[held] + 1
            heads = np.flatnonzero(np.r_[True, co[1:] != co[:-1]])
            node = co[heads]
            if (cl == cl[0]).all():
                impact = shard.impacts[cl[0]][cs]
            else:
                impact = np.empty(len(cs), np.int64)
                for x in np.unique(cl).tolist():
                    impact[cl == x] = shard.impacts[x][cs[cl == x]]
            bounds = np.add.reduceat(cw * impact, heads)
            firsts = first[chosen][node] + (bit << shift[node])
            leaf = cl[heads] == shard.levels
            if leaf.any():
                top += [x for x in zip(bounds[leaf].tolist(), shard.ids[firsts[leaf]].tolist(), strict=True) if x[0] > 0]
                top = sorted(top, key=lambda x: (-x[0], x[1]))[:k]
            inner = ~leaf
            counts = np.diff(np.r_[heads, len(cs)])
            grown.append((cl[heads][inner], firsts[inner], bounds[inner], len(s) + heads[inner], counts[inner]))
            s, e, w = np.concatenate([s, cs]), np.concatenate([e, ce]), np.concatenate([w, cw])
        level, first, bound, start, size = (np.concatenate(x) for x in zip(*grown, strict=True))
        if len(s) > 4 * size.sum() + 4096:  # ranges of nodes that are gone
            at = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            s, e, w = s[at], e[at], w[at]
            start = np.r_[0, np.cumsum(size)[:-1]]
    return top


def _searcher(queries, k: int):
    """Rows (shard, name, level, piece, data) in order to (q, doc_id, score), the best of a task."""

    def run(batches):
        best: dict[int, list[tuple[int, int]]] = {}

        def search(pieces):
            shard = Shard({key: b"".join(x) for key, x in pieces.items()})
            for q, terms, weights in queries.value:
                best[q] = best_first(shard, terms, weights, k, best.get(q, []))

        held, pieces = None, defaultdict(list)
        for batch in batches:
            for number, name, level, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "name", "level", "data")), strict=True):
                if number != held and pieces:
                    search(pieces)
                    pieces = defaultdict(list)
                held = number
                pieces[name, level].append(data)
        if pieces:
            search(pieces)
        out = [(q, doc, score) for q, found in best.items() for score, doc in found]
        columns = list(zip(*out, strict=True)) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q", "doc_id", "score"])

    return run


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(text, UPPER, LOWER), NOT_TERMS), lambda x: x != ""))


def _blocks(queries: DataFrame, most: int):
    """Lists of (q, terms, weights), of ``most`` bytes at least one and then as many as fit."""
    block, size = [], 0
    for r in queries.toLocalIterator():
        terms = [t.encode() for t in r["terms"]]
        own = sum(map(len, terms)) + 16 * len(terms)
        if block and size + own > most:
            yield block
            block, size = [], 0
        block.append((r["q"], terms, list(r["weights"])))
        size += own
    if block:
        yield block


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each row of ``queries``, equal scores by id.

    Rows without terms, or with none that a document has, give no rows. Rows that repeat an item are searched
    each on its own. Documents that repeat an id are documents each; of equal scores and ids any may take part.
    """
    spark = queries.sparkSession
    asked = stored(queries.select(column(id_col).alias("item_id"), column(text_col).alias("text")).withColumn("q", F.monotonically_increasing_id()))
    schema = StructType([StructField("item_id", asked.schema["item_id"].dataType), *StructType.fromDDL("rank int, doc_id long, score long").fields])
    if not index.docs:
        return spark.createDataFrame([], schema)
    words = asked.select("q", F.explode(distinct_terms(F.col("text"))).alias("term"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = words.join(index.vocabulary, "term").select("q", F.struct("term", weight.alias("w")).alias("t"))
    ready = stored(weighted.groupBy("q").agg(F.sort_array(F.collect_list("t")).alias("t")).select("q", F.col("t.term").alias("terms"), F.col("t.w").alias("weights")))
    found = None
    for block in _blocks(ready, query_bytes):
        sent = spark.sparkContext.broadcast(block)
        pieces = index.pieces.repartition("shard").sortWithinPartitions("shard", "name", "level", "piece")
        got = stored(pieces.mapInArrow(_searcher(sent, k), StructType([StructField(c, LongType()) for c in ("q", "doc_id", "score")])))
        found = got if found is None else found.union(got)
        sent.unpersist()
    if found is None:
        return spark.createDataFrame([], schema)
    from pyspark.sql import Window

    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    named = ranked.join(asked.select("q", "item_id"), "q")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``build`` and ``search`` in one. Null and empty texts have no terms; empty tables give an empty result; further columns are ignored."""
    return search(build(docs, doc_id, doc_text), queries, k, item_id, item_text)


_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
    n AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
    tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT DISTINCT i, item_id, term FROM (SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark))),
    s AS (
      SELECT q.i, q.item_id, n.r, n.doc_id,
             CAST(sum(CAST(floor(1000 * ln((2 * total.docs + 2) / (2 * df.df + 1))) AS BIGINT)
                      * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * n.n * total.docs) // total.terms)))) AS BIGINT) AS score
      FROM q JOIN df USING (term) JOIN tf USING (term) JOIN n USING (r), total GROUP BY ALL
    )
    SELECT item_id, rank, doc_id, score FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0
    ) WHERE rank <= 10
"""
