"""Language identification by nearest centroid over TF-IDF character n-grams.

A text becomes a vector of hashed letter uni-, bi- and trigrams: logarithmic counts times inverse
document frequency, scaled to length one. Each language has several centroids, found by spherical
k-means over a bounded sample of its labelled rows; a text gets the language of the centroid with
the largest cosine. It is rejected if it is farther from every centroid, by a margin, than nearly all
texts of similar length, unless it is far from the second language as well: distance alone tells an unusual
vocabulary, a gap tells a language. It is also rejected if fewer of its signs are letters than in nearly all
texts. Document frequencies, the cosines of texts by length and the shares of letters cover all rows that may
be learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import column, kept_columns, pack, row_with

FEATURES = 4096
#: Hash space of each order: unigrams, bigrams, trigrams.
SPANS = ((0, 256), (256, 1024), (1280, 2816))
PIECE = 1 << 19
ROWS = 128
UNKNOWN = "und"
#: Cells of a histogram of cosines, and the rows that a length's floor is read from at least.
CELLS = 1000
ENOUGH = 100
#: A text below the floor is kept if its cosine is this at least and that to the second language at most so much of
#: it; more is asked of texts with more n-grams than SHORT, where noise comes as near to one language as that.
DECIDED, GAP, LONG_GAP, SHORT = 0.11, 0.9, 0.75, 640

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _add_grams(text: str, into: np.ndarray) -> float:
    """Add the n-gram counts of ``text``, in pieces that overlap by two characters; the share of letters among what is no space."""
    letters = _letter_table()
    found, signs = 0, 0
    text = text.lower()
    for at in range(0, len(text), PIECE):
        back = 2 if at else 0
        codes = np.frombuffer(text[at - back : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        fresh = codes[back:]
        found += int(np.count_nonzero(letters[fresh]))
        signs += len(fresh) - int(np.count_nonzero((fresh == 32) | (fresh - 9 < 5)))
        codes = np.where(letters[codes], codes, np.uint32(32))
        # one space for a run of others, and one at either end of the text
        codes = np.concatenate([np.uint32([32] * (not at)), codes, np.uint32([32] * (at + PIECE >= len(text)))])
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]].astype(np.uint64)
        h = codes
        for order, (start, width) in enumerate(SPANS):
            if order:
                h = h[:-1] * np.uint64(0x9E3779B1) + codes[order:]
            new = h[max(0, back - order) :] if at else h
            slot = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(width)
            into += np.bincount(slot.astype(np.int64) + start, minlength=FEATURES)
    return found / max(1, signs)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def vectors(texts: list[str | None], idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (zero where there is no letter), numbers of n-grams, and shares of letters."""
    counts, shares = np.zeros((len(texts), FEATURES)), np.zeros(len(texts))
    for i, text in enumerate(texts):
        if has_letter(text):
            shares[i] = _add_grams(text, counts[i])
    sizes = counts.sum(axis=1)
    x = np.log1p(counts)
    if idf is not None:
        x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1), sizes, shares


def _blocks(texts: list):
    for at in range(0, len(texts), ROWS):
        yield at, texts[at : at + ROWS]


def _document_frequencies(batches):
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for _, texts in _blocks(batch.column(0).to_pylist()):
            x, sizes, _ = vectors(texts)
            df += (x > 0).sum(axis=0)
            n += int((sizes > 0).sum())
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, df[some]])], names=["feature", "n"])


def _sampled(batches):
    for batch in batches:
        x, sizes, _ = vectors(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["lang", "size", "x"])


@dataclass
class Model:
    idf: np.ndarray
    names: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray  # least cosine by log2 of the number of n-grams
    letters: float = 0.0  # least share of letters

    def plain(self) -> tuple:
        """Arrays and lists only, which executors without this package can read from a broadcast."""
        return self.idf, self.names, self.centroids, self.owner, self.floor, self.letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to the nearest centroid, and whether the text is rejected."""
        x, sizes, shares = vectors(texts, self.idf)
        if not len(self.names):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = x @ self.centroids.T
        best = cos.argmax(axis=1)
        near = np.clip(cos[np.arange(len(texts)), best], 0, 1)
        none = sizes == 0
        names = [UNKNOWN if e else self.names[self.owner[b]] for e, b in zip(none.tolist(), best.tolist(), strict=True)]
        # the best cosine of another language; with one language only there is no gap to go by
        other = np.where(self.owner[None, :] == self.owner[best][:, None], -1.0, cos).max(axis=1, initial=-1.0)
        decided = (near >= DECIDED) & (other > -1) & (other <= np.where(sizes < SHORT, GAP, LONG_GAP) * near)
        far = (near < self.floor[_bin(sizes)]) & ~decided
        return names, np.where(none, 0.0, near), none | far | (shares < self.letters)


def _bin(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(sizes, 1)).astype(int), 31)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts with the mean and what is farthest from those chosen."""
    centres = [x.mean(axis=0)]
    centres[0] /= max(np.linalg.norm(centres[0]), 1e-12)
    while len(centres) < min(k, len(x)):
        centres.append(x[(x @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def _clusterer(idf: np.ndarray, k: int):
    """The centroids of one language's sample, whose vectors are as many as ``sample_rows`` lets be."""

    def run(pdf):
        import pandas as pd

        v = np.frombuffer(b"".join(sorted(pdf["x"])), np.float16).reshape(-1, FEATURES).astype(np.float32)
        v *= idf.astype(np.float32)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        c = _cluster(v, k)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "nth": range(len(c)), "c": [x.astype(float).tolist() for x in c]})

    return run


def fit(docs: DataFrame, learnable: Column, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 1000, clusters: int = 4, quantile: float = 0.001, margin: float = 0.75) -> Model:
    """Learn from rows where ``learnable`` holds and text and language are not null.

    ``sample_rows`` bounds each language's sample in expectation; it is drawn by a hash of the text,
    equal texts count once, and each language is clustered in a task of its own, so only centroids
    (32 KB each) reach the driver. Document frequencies are summed over all learnable rows, and so
    are histograms of their cosines by length; ``margin`` times the low ``quantile`` of a length is
    the floor below which texts are rejected, as for their shares of letters. Without learnable rows the
    model knows no language and rejects all.
    """
    text, lang = column(text_col), column(lang_col)
    rows = docs.where(learnable & text.isNotNull() & lang.isNotNull()).select(text.alias("text"), lang.alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.ones(FEATURES), [], np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(32))
    df = rows.select("text").mapInArrow(_document_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = {r["feature"]: r["n"] for r in df.collect()}
    total = found.pop(-1, 0)
    idf = np.full(FEATURES, np.log(1 + total))
    for f, n in found.items():
        idf[f] = np.log((1 + total) / (1 + n)) + 0.1
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_rows / n))])
    # the salt sets the draw apart from other uses of a text's hash
    draw = F.pmod(F.xxhash64(F.lit("langid"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < share[F.col("lang")]).withColumn("h", F.xxhash64("text")).dropDuplicates(["lang", "h"])
    drawn = sample.select("text", "lang").mapInArrow(_sampled, "lang string, size double, x binary").where("size > 0")
    made = drawn.groupBy("lang").applyInPandas(_clusterer(idf, clusters), "lang string, nth int, c array<double>").collect()
    made.sort(key=lambda r: (r["lang"], r["nth"]))
    if not made:
        return Model(idf, [], np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(32))
    names = sorted({r["lang"] for r in made})
    centroids, owner = np.array([r["c"] for r in made]), np.array([names.index(r["lang"]) for r in made])
    model = Model(idf, names, centroids, owner, np.zeros(32))
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    cells = rows.select("text").mapInArrow(_cosines(shared), "bin long, cell long, n long").groupBy("bin", "cell").agg(F.sum("n").alias("n"))
    counted = np.zeros((33, CELLS), np.int64)
    for r in cells.collect():
        counted[r["bin"], r["cell"]] = r["n"]
    return Model(idf, names, centroids, owner, _floors(counted[:32], quantile) * margin, _low(counted[32], quantile) * margin)


def _low(row: np.ndarray, quantile: float) -> float:
    """The low quantile of a histogram of CELLS cells over [0, 1]."""
    return float(np.searchsorted(row.cumsum(), max(1, quantile * row.sum()))) / CELLS if row.any() else 0.0


def _floors(counted: np.ndarray, quantile: float) -> np.ndarray:
    """The low quantile of each bin's cosines. Bins with few rows take the least of their own and their neighbours'.

    The cosine of a short text grows as the root of its length, so a longer neighbour's floor is scaled down.
    """
    low = lambda row: _low(row, quantile)
    n = counted.sum(axis=1)
    known = {int(i): low(counted[i]) for i in np.flatnonzero(n >= ENOUGH)}
    if not known and n.sum():
        known = {int(np.searchsorted(n.cumsum(), n.sum() / 2)): low(counted.sum(axis=0))}
    floor = np.zeros(len(counted))
    for i in range(len(counted) if known else 0):
        near = [known[j] * 2.0 ** (-max(j - i, 0) / 2) for j in (max((j for j in known if j <= i), default=None), min((j for j in known if j >= i), default=None)) if j is not None]
        floor[i] = min(near + [low(counted[i])] * bool(n[i]))
    return floor


def _cosines(model):
    """Histograms of cosines by length, and in the last row that of the shares of letters."""

    def run(batches):
        counted = np.zeros((33, CELLS), np.int64)
        idf, _, centroids, *_ = model.value
        for batch in batches:
            for _, texts in _blocks(batch.column(0).to_pylist()):
                x, sizes, shares = vectors(texts, idf)
                near = np.clip((x @ centroids.T).max(axis=1), 0, 1)
                some = sizes > 0
                np.add.at(counted[32], np.minimum(shares[some] * CELLS, CELLS - 1).astype(int), 1)
                np.add.at(counted, (_bin(sizes[some]), np.minimum(near[some] * CELLS, CELLS - 1).astype(int)), 1)
        bins, cells = np.nonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(cells), pa.array(counted[bins, cells])], names=["bin", "cell", "n"])

    return run


def _predictor(model):
    def run(batches):
        own = Model(*model.value)
        for batch in batches:
            names, near, far = [], [], []
            for _, texts in _blocks(batch.column(1).to_pylist()):
                a, b, c = own.predict(texts)
                names += a
                near.append(b)
                far.append(c)
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), cat(near, float), cat(far, bool)], names=["row", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (the caller's columns), ``lang_pred``, ``score`` and ``rejected`` for every row.

    Texts that are null, empty or without a letter are ``und``, score 0 and rejected. Long texts
    are read whole, piece by piece. Ties go to the first language by name. Repeated rows and empty
    tables need no care: every row is judged by itself.
    """
    packed = pack(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    return packed.mapInArrow(_predictor(shared), row_with(packed, "lang_pred string, score double, rejected boolean"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(column(id_col).cast("string")) % 4 == 2, F.lit(False))


def language_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row; null ids count as learnable."""
    model = fit(docs, ~held_out(id_col))
    out = identify(docs.select(F.col(id_col).alias("doc_id"), "text"), model).select("row.doc_id", "lang_pred", "score", "rejected")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that language identification does not reject, with the caller's columns.

    Null, empty and letterless texts are rejected, and so is everything if no row has a language to
    learn from. Long texts are judged whole. Rows that repeat stay or go together; ties in the
    cosine don't matter here. An empty table stays empty; columns may have any name.
    """
    model = fit(docs, ~held_out(id_col))
    return kept_columns(identify(docs, model).where(~F.col("rejected")), docs)
