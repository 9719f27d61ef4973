"""Toxic spans by a linear-chain conditional random field over words.

Two states, clean and toxic. A word's evidence is how much more often it, its first four and its
first five letters occur in documents labelled toxic than in others; these log-odds, with a bias
and the transitions, are the field's features. Token labels for training come from the document
labels: in a toxic document, words with strong evidence are toxic. Forward-backward marginals give
the spans; their noisy-or, calibrated on the labelled sample, is the document's score.

The fit uses a bounded sample of labelled documents, ``SAMPLE`` of each label at most in
expectation. Copies would make all their words look toxic, so evidence counts near copies once:
documents with the same three smallest word hashes are one. The field is trained on blocks of
words from all of these documents, ``BLOCKS`` of each label at most in expectation, whose features
are made in tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import pack, row_with, stored

WORD = re.compile(r"[^\W\d_]+")
SAMPLE = 6000
#: Words of evidence kept at most, strongest first.
LEXICON = 8192
#: Blocks of the sample's documents on which the field is trained, of each label, and words of a block.
BLOCKS, BLOCK = 500, 400
#: Word hashes by which near copies are known.
SKETCH = 3
STRONG = 2.5
LANES = 512
#: Words that one pass of the field covers.
PASS = 1 << 18
CACHE = 200_000
NAMES = ("", "4:", "5:")


def keys(word: str) -> list[str]:
    """The word and its first letters, marked by length."""
    return [word, *(f"{m}{word[: int(m[0])]}" for m in NAMES[1:])]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; each is lowered by itself, so that it keeps its place in the text."""
    if not text:
        return []
    return WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


def _slices(batches, rows: int = 256):
    """Few rows at a time, so that Python's copies of their words stay small."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def _document_features(batches):
    """(feature, toxic, group) for the distinct features of each document."""
    from xxhash import xxh3_64_intdigest

    for b in _slices(batches):
        f, t, g = [], [], []
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ws = set(words_of(text))
            if not ws:
                continue
            group = xxh3_64_intdigest(repr(sorted(map(xxh3_64_intdigest, ws))[:SKETCH])) >> 1
            own = {k for w in ws for k in keys(w)}
            f += own
            t += [toxic] * len(own)
            g += [group] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(t, pa.int32()), pa.array(g, pa.int64())], names=["feature", "toxic", "grp"])


def _sweep(e: np.ndarray, new: np.ndarray, start: float, a: float, b: float, c: float, d: float) -> np.ndarray:
    """x[t] = e[t] * (a x[t-1] + b) / (c x[t-1] + d), and e[t] * start where ``new``.

    The maps are 2 x 2 matrices; lanes of the sequence are multiplied side by side, then carried over.
    """
    n = len(e)
    steps = -(-n // LANES)
    pad = steps * LANES - n
    ee = np.concatenate([e, np.ones(pad)]).reshape(LANES, steps).T
    nn = np.concatenate([new, np.ones(pad, bool)]).reshape(LANES, steps).T
    p, q, r, s = np.ones(LANES), np.zeros(LANES), np.zeros(LANES), np.ones(LANES)
    for i in range(steps):
        on, x = nn[i], ee[i]
        p, q, r, s = x * (a * p + b * r), x * (a * q + b * s), c * p + d * r, c * q + d * s
        if on.any():
            p, q, r, s = np.where(on, 0, p), np.where(on, x * start, q), np.where(on, 0, r), np.where(on, 1, s)
        size = 1 / (p + q + r + s)
        p, q, r, s = p * size, q * size, r * size, s * size
    first, x = np.empty(LANES), 0.0
    for i in range(LANES):
        first[i] = x
        x = (p[i] * x + q[i]) / (r[i] * x + s[i])
    out, x = np.empty((steps, LANES)), first
    for i in range(steps):
        x = np.where(nn[i], start, (a * x + b) / (c * x + d)) * ee[i]
        out[i] = x
    return out.T.reshape(-1)[:n]


@dataclass
class Model:
    evidence: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 1.0, 1.0]))
    #: log of the start ratio and of the transitions clean-toxic, toxic-clean, toxic-toxic (clean-clean: 0)
    moves: np.ndarray = field(default_factory=lambda: np.array([-2.0, -2.0, 0.0, 0.0]))
    scale: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    cache: dict[str, int] = field(default_factory=dict)
    rows: list[list[float]] = field(default_factory=lambda: [[1.0, 0.0, 0.0, 0.0]])

    def plain(self) -> tuple:
        """A dict and arrays, which executors without this package can read from a broadcast."""
        return self.evidence, self.weights, self.moves, self.scale

    def _row(self, word: str) -> int:
        """Number of the word's feature row; words without evidence share row 0."""
        at = self.cache.get(word)
        if at is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
                del self.rows[1:]
            own = [self.evidence.get(k, 0.0) for k in keys(word)]
            at = 0
            if any(own):
                at = len(self.rows)
                self.rows.append([1.0, *own])
            self.cache[word] = at
        return at

    def features(self, words: list[str]) -> np.ndarray:
        if not self.evidence:
            return np.tile(self.rows[0], (len(words), 1))
        get, out = self.cache.get, np.empty((len(words), len(self.rows[0])))
        for at in range(0, len(words), CACHE // 2):  # rows stay valid within a part
            part = words[at : at + CACHE // 2]
            if len(self.cache) > CACHE // 2:
                self.cache.clear()
                del self.rows[1:]
            ids = [i if (i := get(w)) is not None else self._row(w) for w in part]
            out[at : at + len(part)] = np.array(self.rows)[ids]
        return out

    def messages(self, x: np.ndarray, new: np.ndarray):
        """Emission, forward and backward ratios (toxic to clean) of each word."""
        e = np.exp(np.clip(x @ self.weights, -30, 30))
        start, ab, ba, bb = np.exp(self.moves)
        ahead = _sweep(e, new, start, bb, ab, ba, 1.0)
        last = np.r_[new[1:], True]
        behind = _sweep(e[::-1], last[::-1], 1.0, bb, ba, ab, 1.0)[::-1]
        return e, ahead, behind

    def marginals(self, x: np.ndarray, new: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        e, ahead, behind = self.messages(x, new)
        both = ahead * behind / e
        return both / (1 + both)

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Each word's probability to be toxic, document by document."""
        sizes = [len(w) for w in texts]
        x = self.features([w for ws in texts for w in ws])
        new = np.zeros(len(x), bool)
        starts = np.cumsum([0, *sizes])
        new[[s for s, n in zip(starts[:-1].tolist(), sizes, strict=True) if n]] = True
        return np.split(self.marginals(x, new), starts[1:-1])

    def score(self, p: np.ndarray) -> float:
        z = self.scale[0] + self.scale[1] * np.log(1e-4 - np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _train(model: Model, blocks: list[tuple[np.ndarray, int]], rounds: int = 120) -> None:
    """Gradient ascent (Adam) on the field's log-likelihood, with a small ridge.

    ``blocks``: the evidence of each word of a block, and its document's label.
    """
    sizes = [len(x) for x, _ in blocks]
    x = np.concatenate([np.ones((sum(sizes), 1)), np.concatenate([x for x, _ in blocks])], axis=1)
    new = np.zeros(len(x), bool)
    new[np.cumsum([0, *sizes[:-1]])] = True
    y = (x[:, 1:].max(axis=1) >= STRONG) & np.repeat([t == 1 for _, t in blocks], sizes)
    follow = np.flatnonzero(~new)
    seen = np.array([y[new].sum(), (~y[follow - 1] & y[follow]).sum(), (y[follow - 1] & ~y[follow]).sum(), (y[follow - 1] & y[follow]).sum()], float)
    theta = np.concatenate([model.weights, model.moves])
    m, v = np.zeros(8), np.zeros(8)
    for i in range(1, rounds + 1):
        model.weights, model.moves = theta[:4], theta[4:]
        e, ahead, behind = model.messages(x, new)
        p = ahead * behind / e
        p = p / (1 + p)
        _, ab, ba, bb = np.exp(model.moves)
        a, b = ahead[follow - 1], behind[follow]
        parts = np.array([ab * b, ba * a, bb * a * b])
        pairs = parts / (1 + parts.sum(axis=0))
        grad = np.concatenate([x.T @ (y - p), seen - np.r_[p[new].sum(), pairs.sum(axis=1)]]) / len(blocks) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    model.weights, model.moves = theta[:4], theta[4:]


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    """Logistic regression of the label on the noisy-or, weighted to the labels' own shares."""
    x, beta = np.c_[np.ones(len(z)), z], np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - 1e-2 * beta
        beta = beta + np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(2), grad)
    model.scale = beta


def _training_blocks(evidence):
    """Blocks of consecutive words of whole documents: label, hash of the place, evidence of each word."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        model = Model(evidence.value)
        for b in _slices(batches):
            out = []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words_of(text)
                for at in range(0, len(ws), BLOCK):
                    part = ws[at : at + BLOCK]
                    out.append((toxic, xxh3_64_intdigest(" ".join(part), at) >> 1, model.features(part)[:, 1:].astype(np.float32).tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["toxic", "place", "x"])

    return run


def _strengths(shared):
    def run(batches):
        model = Model(*shared.value)
        for b in _slices(batches):
            texts = [words_of(t) for t in b.column(0).to_pylist()]
            z = [float(np.log(1e-4 - np.log1p(-np.minimum(p, 1 - 1e-9)).sum())) for p in (model.tag(texts) if texts else [])]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(z, pa.float64())], names=["toxic", "z"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Labels of these rows are never learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _drawn(name: str, key: str) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.pmod(F.xxhash64(F.lit(name), key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, blocks: int = BLOCKS) -> Model:
    """Learn from labels of rows that are not held out.

    ``sample`` bounds the labelled documents of each label and ``blocks`` the blocks of BLOCK words
    on which the field is trained, both in expectation, drawn by hashes; that bounds the broadcast
    of ids, what is stored and what reaches the driver (5 KB for each block). Rows without a label,
    an id or a text teach nothing; an id with both labels counts as toxic; equal texts with one
    label count once. Without both labels the model is neutral. Empty tables are fine.
    """
    model = Model()
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return model
    share = F.when(F.col("toxic") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))
    drawn = known.where(_drawn("toxicity", "doc_id") < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic", F.sha2("text", 256).alias("own"))
    rows = stored(rows.dropDuplicates(["own", "toxic"]).select("text", "toxic"))
    made = rows.select("text", "toxic").mapInArrow(_document_features, "feature string, toxic int, grp long").distinct()
    made = stored(made.groupBy("feature").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")))
    sizes = stored(rows.select("text", "toxic").mapInArrow(_document_features, "feature string, toxic int, grp long").select("toxic", "grp").distinct()).groupBy("toxic").count().collect()
    sizes = {r["toxic"]: r["count"] for r in sizes}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    lexicon = made.where(F.col("bad") >= max(3, bad // 100)).withColumn("odds", odds).where("odds > 1").orderBy(F.desc("odds"), "feature").limit(LEXICON)
    model.evidence = {r["feature"]: min(8.0, r["odds"]) for r in lexicon.collect()}
    if not model.evidence:
        return model
    evidence = docs.sparkSession.sparkContext.broadcast(model.evidence)
    made = stored(rows.mapInArrow(_training_blocks(evidence), "toxic int, place long, x binary").dropDuplicates(["toxic", "place"]))
    n = {r["toxic"]: r["n"] for r in made.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, blocks / n.get(1, 1))).otherwise(min(1.0, blocks / n.get(0, 1)))
    chosen = sorted(made.where(_drawn("blocks", "place") < share).collect(), key=lambda r: (r["place"], r["toxic"]))
    if chosen:
        _train(model, [(np.frombuffer(r["x"], np.float32).reshape(-1, len(NAMES)).astype(float), r["toxic"]) for r in chosen])
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())
    got = rows.select("text", "toxic").mapInArrow(_strengths(shared), "toxic int, z double").toArrow()
    y, z = got["toxic"].to_numpy(), got["z"].to_numpy()
    n = {t: max(1, int((y == t).sum())) for t in (0, 1)}
    order = np.lexsort((y, z))
    _calibrate(model, z[order], y[order], np.where(y[order] == 1, counts[1] / n[1], counts[0] / n[0]) * len(y) / sum(counts.values()))
    return model


def _scorer(shared, threshold):
    def run(batches):
        model = Model(*shared.value)
        for b in _slices(batches):
            texts, scores, spans, group, size = b.column(1).to_pylist(), [], [], [], 0

            def settle(group):
                for (text, _), p in zip(group, model.tag([w for _, w in group]), strict=True):
                    scores.append(model.score(p))
                    found = []
                    if len(p) and p.max() >= threshold:
                        at = [m.span() for m in WORD.finditer(text)]
                        for i in np.flatnonzero(p >= threshold).tolist():
                            if found and found[-1]["last"] == i - 1:
                                found[-1] |= {"stop": at[i][1], "last": i}
                            else:
                                found.append({"start": at[i][0], "stop": at[i][1], "last": i})
                    spans.append([{"start": f["start"], "stop": f["stop"]} for f in found])

            for text in texts:
                ws = words_of(text)
                group.append((text or "", ws))
                size += len(ws)
                if size >= PASS:
                    settle(group)
                    group, size = [], 0
            if group:
                settle(group)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["row", "score", "spans"])

    return run


def score_rows(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``row`` (the caller's columns), ``score`` and ``spans`` (character offsets of toxic runs of words).

    Null and empty texts, and texts without a letter, get the score of no evidence and no span.
    Long texts are tagged whole. Offsets count the characters of the text as it is. Repeated rows
    score alike; an empty table gives an empty result; columns may have any name.
    """
    packed = pack(docs, text_col)
    kind = row_with(packed, "score double, spans array<struct<start:int,stop:int>>")
    return packed.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model.plain()), threshold), kind)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_spans, spans`` for every row.

    Rows with a null id are scored and count as not held out; null, empty and very long texts,
    repeated rows and labels, ties and empty tables as in :func:`fit` and :func:`score_rows`.
    """
    model = fit(docs, labels)
    out = score_rows(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")
