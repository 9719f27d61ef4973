"""Long matches between candidate texts and training texts, by windows of characters.

Windows of ``threshold`` characters that both sides have are paired into windows twice as long, again
and again; each candidate then looks for the longest string that starts and ends with its longest
windows. All joins are semi-joins with distinct windows, so texts never meet pair by pair, however
many share a passage, and no text travels with its windows. A candidate's window is a row only where a
broadcast bitmap of the training windows may hold it, so that the rest of its text never leaves its task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from parlance.functions.text import windows
from parlance.plans.bitmaps import broadcast_bitmap, held
from parlance.plans.durable import materialized

SEED = 16
#: Characters that a task hashes at once (few enough for a core's cache), windows that it hands on at once.
BLOCK = 1 << 13
ROWS = 1 << 17
PRIME = (1 << 31) - 1
BASES = (48271, 69621, 1000003, 16777619)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n`` - 1 in the prime field, doubled piece by piece."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, PRIME)) % PRIME
        done += more
    return out


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME, in place: what is above its 31 bits is worth as much as below, so no division is needed."""
    prime, bits = np.uint64(PRIME), np.uint64(31)
    for _ in range(2):
        high = x >> bits
        x &= prime
        x += high
    # without a sign, what is below PRIME becomes huge by taking it off
    return np.minimum(x, x - prime, out=x)


def window_hasher(size: int):
    """A function that gives two 62-bit hashes of windows of ``size`` in an array of code points.

    It returns the places of the windows and their hashes; with a bitmap, of those only that it may hold.
    """
    up = [powers(b, BLOCK + size) for b in BASES]
    down = [powers(pow(b, -1, PRIME), BLOCK + size) for b in BASES]

    def sums(chars: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(reduced(chars * up[i][: len(chars)]), out=out[1:])
        return out

    def hashed(chars: np.ndarray, i: int) -> np.ndarray:
        # the sum of a window counts its place as a power, which the inverse power takes out
        total, n = sums(chars, i), len(chars) - size + 1
        return reduced(reduced(total[size:] - total[:-size]) * down[i][:n]).view(np.int64)

    def some(chars: np.ndarray, at: np.ndarray, i: int) -> np.ndarray:
        # all characters of the windows at once: a step for each place in a window would cost more than the windows
        products = reduced(chars[at[:, None] + np.arange(size)] * up[i][:size])
        return reduced(products.sum(axis=1, dtype=np.uint64)).view(np.int64)

    def hashes(chars: np.ndarray, bitmap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h1 = hashed(chars, 0) << 31 | hashed(chars, 1)
        if bitmap is None:
            return np.arange(len(h1)), h1, hashed(chars, 2) << 31 | hashed(chars, 3)
        at = np.flatnonzero(held(bitmap, h1))
        if not len(at):
            return at, h1[:0], h1[:0]
        h2 = some(chars, at, 2) << 31 | some(chars, at, 3)
        kept = held(bitmap, h2)
        return at[kept], h1[at[kept]], h2[kept]

    return hashes


def positioned(texts: DataFrame, ident: str, text: str, size: int, stride: int = 1, bitmap: Broadcast | None = None) -> DataFrame:
    """``ident, pos, h1, h2``: a 124-bit digest of the window at each (sampled) position from 0; null and short texts have none.

    With a bitmap of digests only windows that it may hold.
    """
    schema = StructType([texts.schema[ident], *[StructField(n, LongType()) for n in ("pos", "h1", "h2")]])

    def blocks(batches):
        hashes = window_hasher(size)
        wanted = bitmap.value if bitmap else None
        for batch in batches:
            ids = batch.column(0)
            for i, value in enumerate(batch.column(1)):
                chars = np.frombuffer((value.as_py() or "").encode("utf-32-le"), np.uint32)
                for start in range(0, len(chars) - size + 1, BLOCK):
                    pos, h1, h2 = hashes(chars[start : start + BLOCK + size - 1].astype(np.uint64), wanted)
                    pos = pos + start
                    kept = pos % stride == 0
                    if kept.any():
                        yield ids, np.full(kept.sum(), i), pos[kept], h1[kept], h2[kept]

    def each(batches):
        waiting, rows, column = [], 0, None
        for ids, *arrays in blocks(batches):
            if waiting and (rows >= ROWS or ids is not column):
                yield packed(column, waiting)
                waiting, rows = [], 0
            column, rows = ids, rows + len(arrays[0])
            waiting.append(arrays)
        if waiting:
            yield packed(column, waiting)

    def packed(ids, arrays):
        at, *columns = (np.concatenate(a) for a in zip(*arrays))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *map(pa.array, columns)], names=schema.names)

    return texts.select(ident, text).mapInArrow(each, schema)


def seed_pairs(candidates: DataFrame, training: DataFrame, threshold: int) -> DataFrame:
    """Distinct ``cand_id, train_id`` that share a sampled seed. Inputs: (cand_id, norm), (train_id, norm)."""
    seed = min(threshold, SEED)
    t = training.where(F.length("norm") >= threshold)
    c = candidates.where(F.length("norm") >= threshold)
    index = materialized(positioned(t, "train_id", "norm", seed, threshold - seed + 1).select("train_id", "h1", "h2").distinct())
    bitmap = broadcast_bitmap(index.select("h1", "h2").distinct(), "h1", "h2")
    probes = positioned(c, "cand_id", "norm", seed, bitmap=bitmap).select("cand_id", "h1", "h2").distinct()
    return probes.join(index, ["h1", "h2"]).select("cand_id", "train_id").distinct()


def doubled(hits: DataFrame, size: int) -> DataFrame:
    """Windows of twice ``size`` characters, where both halves are among ``hits``."""
    ends = hits.select("id", (F.col("pos") - size).alias("pos"), F.col("h1").alias("e1"), F.col("h2").alias("e2"))
    return hits.join(ends, ["id", "pos"]).select("id", "pos", F.xxhash64("h1", "h2", "e1", "e2").alias("h1"), F.xxhash64(F.lit(7), "h1", "h2", "e1", "e2").alias("h2"))


def shared_levels(c: DataFrame, t: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``size, id, pos, h1, h2`` of both sides: windows of ``size``, twice, four times ... that the other side has too.

    A text of the left side has rows of its largest size only.
    """
    found = []
    while True:
        # the distinct windows are a table, so Spark knows their size and broadcasts few, shuffles many
        c = materialized(c.join(materialized(t.select("h1", "h2").distinct()), ["h1", "h2"], "left_semi").select("id", "pos", "h1", "h2"))
        t = materialized(t.join(materialized(c.select("h1", "h2").distinct()), ["h1", "h2"], "left_semi").select("id", "pos", "h1", "h2"))
        found.append((size, c, t))
        if c.isEmpty():
            break
        c, t, size = doubled(c, size), doubled(t, size), 2 * size
    left = [a.join(b.select("id").distinct(), "id", "left_anti").withColumn("size", F.lit(n)) for (n, a, _), (_, b, _) in zip(found, found[1:])]
    right = [t.withColumn("size", F.lit(n)) for n, _, t in found]
    return reduce(DataFrame.unionByName, left, found[-1][1].withColumn("size", F.lit(size))), reduce(DataFrame.unionByName, right)


def longest_matches(candidates: DataFrame, training: DataFrame, threshold: int) -> DataFrame:
    """``cand_id, longest`` for every candidate: the longest common run of ``threshold`` characters or more, else 0.

    Of a candidate's largest windows two, the second ``d`` positions on, hold all characters of a string of
    size + ``d``; that a training text has the same two in the same distance is true up to the longest match
    and false beyond, so ``d`` is found by bisection for all candidates at once. The first ``d`` tried is the
    length of the longest run of windows, mostly the answer. Null and short texts match nothing.
    """
    t = materialized(positioned(training, "train_id", "norm", threshold).withColumnRenamed("train_id", "id"))
    bitmap = broadcast_bitmap(t.select("h1", "h2").distinct(), "h1", "h2")
    c = positioned(candidates, "cand_id", "norm", threshold, bitmap=bitmap).withColumnRenamed("cand_id", "id")
    c, t = (materialized(x) for x in shared_levels(c, t, threshold))
    line = Window.partitionBy("id").orderBy("pos")
    runs = c.withColumn("run", F.col("pos") - F.row_number().over(line)).groupBy("id", "size", "run").agg(F.count("*").alias("n"))
    most = F.least(F.max("n"), F.col("size")) - 1
    state = materialized(runs.groupBy("id", "size").agg(F.lit(0).cast("long").alias("lo"), most.cast("long").alias("hi")).withColumn("d", F.col("hi")))
    key = ["size", "d", "h1", "h2"]
    while not (tried := state.where("lo < hi").select("id", "size", "d")).isEmpty():
        ends = lambda x: x.select("size", "id", F.col("pos").alias("end"), F.col("h1").alias("e1"), F.col("h2").alias("e2"))
        probes = c.join(tried, ["id", "size"]).withColumn("end", F.col("pos") + F.col("d")).join(ends(c), ["size", "id", "end"])
        probes = materialized(probes.select("id", *key, "e1", "e2"))
        starts = t.join(probes.select(key).distinct(), ["size", "h1", "h2"]).withColumn("end", F.col("pos") + F.col("d"))
        there = starts.join(ends(t), ["size", "id", "end"]).select(*key, "e1", "e2").distinct()
        held = probes.join(there, [*key, "e1", "e2"], "left_semi").select("id", F.lit(True).alias("held")).distinct()
        lo, hi = F.when(F.col("held"), F.col("d")).otherwise(F.col("lo")), F.when(F.col("held") | (F.col("lo") == F.col("hi")), F.col("hi")).otherwise(F.col("d") - 1)
        state = state.join(held, "id", "left").select("id", "size", lo.alias("lo"), hi.alias("hi"))
        state = materialized(state.withColumn("d", F.expr("(lo + hi + 1) div 2")))
    best = state.select(F.col("id").alias("cand_id"), (F.col("size") + F.col("lo")).alias("longest"))
    return candidates.select("cand_id").join(best, "cand_id", "left").select("cand_id", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


def exact_matches(candidates: DataFrame, training: DataFrame) -> DataFrame:
    """``cand_id`` of candidates that equal a training text and aren't empty."""
    known = training.where("norm != ''").select(F.sha2("norm", 256).alias("d")).distinct()
    return candidates.where("norm != ''").withColumn("d", F.sha2("norm", 256)).join(known, "d", "left_semi").select("cand_id")


def ngram_counts(texts: DataFrame, text: str, size: int = 3) -> DataFrame:
    """``gram, n`` over all texts."""
    grams = texts.select(F.explode(F.flatten(windows(F.col(text), size))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def js_divergence(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``jsd`` (base 2) of two tables (gram, n); 0 if either is empty."""
    totals = left.agg(F.sum("n").alias("lt")).crossJoin(right.agg(F.sum("n").alias("rt")))
    both = left.withColumnRenamed("n", "l").join(right.withColumnRenamed("n", "r"), "gram", "full_outer").na.fill(0, ["l", "r"])
    p, q = F.col("l") / F.col("lt"), F.col("r") / F.col("rt")
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)
    return both.crossJoin(F.broadcast(totals)).agg(F.coalesce(F.sum(term(p) + term(q)), F.lit(0.0)).alias("jsd"))
