"""Bootstrap intervals: thousands of resamplings as arrays, added up side by side before anything is shuffled.

Two kinds of weights. Poisson weights come from a hash of sample and row, so they need no common random stream
and SQL can state them. Exact draws come from splitting: a sample's n draws are dealt to the two halves of the rows
by a binomial number, these to their halves, and so on down to blocks, each node with a random stream of its own;
a block finds its share by walking down to it, and deals it to its own rows.

A partition's result is one array of sums, a number for each sample; arrays are merged a few at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from parlance.plans.durable import materialized
from parlance.plans.spread import spread

# The distribution function of a Poisson number with mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999898032318967)
#: The same in 32 bits, and the odd number that the hash multiplies by (27 bits, so that products fit a long).
STEPS = tuple(int(c * (1 << 32)) for c in POISSON)
FACTOR = 0x45D9F3B
SAMPLES = 10_000
#: Numbers that a task holds in one matrix, arrays that one task merges, rows of a block of exact draws.
CELLS, FAN_IN, BLOCK = 1 << 21, 32, 1024
#: Numbers that a core's cache holds.
CACHED = 1 << 16
#: Draws of a sample that is empty, at most.
ATTEMPTS = 64


def hash_key(seed: int, name: str, x: Column) -> Column:
    """32 bits of a row's name, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), x.cast("string"))), 1, 8), 16, 10).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 32 bits over 32 bits."""
    return _mixed(x.astype(np.uint32))


def _mixed(x: np.ndarray, free: np.ndarray | None = None) -> np.ndarray:
    """The same in place, with another array of its form to work in."""
    free = np.empty_like(x) if free is None else free
    for last in (False, False, True):
        np.right_shift(x, np.uint32(16), out=free)
        np.bitwise_xor(x, free, out=x)
        if not last:
            np.multiply(x, np.uint32(FACTOR), out=x)
    return x


def poisson_weights(keys: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """How often each key's row is in each sample: keys x samples."""
    keys, names = keys.astype(np.uint32)[:, None], mix(samples + 1)[None, :]
    out = np.empty((len(keys), names.shape[1]))
    # a few rows at a time, so that they stay in a core's cache from one step to the next
    step = max(1, CACHED // max(1, names.shape[1]))
    for s in range(0, len(keys), step):
        some = keys[s : s + step]
        drawn = some ^ names
        free = np.empty_like(drawn)
        drawn = _mixed(drawn, free)
        np.add(drawn, some, out=drawn)
        drawn = _mixed(drawn, free)
        n = (drawn >= np.uint32(STEPS[0])).view(np.uint8)
        for c in STEPS[1:]:
            n += (drawn >= np.uint32(c)).view(np.uint8)
        out[s : s + step] = n
    return out


def _merge(names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        out = {"g": table.column("g").slice(0, 1), "at": table.column("at").slice(0, 1)}
        for c in names:
            out[c] = pa.array([np.sum([np.asarray(x) for x in table.column(c).to_pylist()], axis=0)], pa.list_(pa.float64()))
        return pa.table(out)

    return run


def summed(parts: DataFrame, names: list[str]) -> DataFrame:
    """One row for each group ``g`` out of rows (g, at, arrays of equal length), one for each g and at: the sums place by place."""
    parts = materialized(parts)
    n = parts.agg(F.max("at")).first()[0]
    while n:
        n = n // FAN_IN
        parts = materialized(parts.withColumn("at", F.floor(F.col("at") / FAN_IN)).groupBy("g", "at").applyInArrow(_merge(names), parts.schema))
    return parts.drop("at")


def interval_ends(estimates: Column, confidence: float) -> tuple[Column, Column]:
    """The ends of an interval in an array of estimates, by nearest rank; null if there are none."""
    tail, n = (1.0 - confidence) / 2, F.size(estimates)
    ranked = F.array_sort(estimates)
    return tuple(F.get(ranked, F.least(n - 1, F.floor(n * F.lit(x)).cast("int"))) for x in (tail, 1.0 - tail))


def _poisson_sums(samples: int):
    def run(batches):
        from pyspark import TaskContext

        places = np.arange(samples)
        w, wd = np.zeros(samples), np.zeros(samples)
        for batch in batches:
            keys, delta = batch.column("key").to_numpy(), batch.column("delta").to_numpy()
            step = max(1, CELLS // samples)
            for s in range(0, len(keys), step):
                weights = poisson_weights(keys[s : s + step], places)
                both = np.stack([np.ones(len(weights)), delta[s : s + step]]) @ weights
                w, wd = w + both[0], wd + both[1]
        if w.any():
            yield pa.RecordBatch.from_pydict({"g": pa.array([0], pa.int32()), "at": pa.array([TaskContext.get().partitionId()], pa.int64()), "w": pa.array([w], pa.list_(pa.float64())), "wd": pa.array([wd], pa.list_(pa.float64()))})

    return run


def bootstrap_interval(values: DataFrame, samples: int = SAMPLES, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """One row ``value, lower, upper`` of the mean of (example_id, delta), by Poisson weights.

    Rows whose delta is null are left out. A sample in which no row has a weight counts as 0; without any row
    the ends are null.
    """
    rows = values.where("delta IS NOT NULL").select(hash_key(seed, "example", F.col("example_id")).alias("key"), F.col("delta").cast("double").alias("delta"))
    sums = summed(spread(rows, "key").mapInArrow(_poisson_sums(samples), "g int, at long, w array<double>, wd array<double>"), ["w", "wd"])
    found = sums.select(F.zip_with("wd", "w", lambda d, w: F.when(w > 0, d / w).otherwise(0.0)).alias("s"))
    low, high = interval_ends(F.col("s"), confidence)
    whole = values.agg(F.avg("delta").alias("value"))
    return whole.join(found, F.lit(True), "left").select("value", low.alias("lower"), high.alias("upper"))


def draws_of_block(n: int, block: int, samples: int, seed: int, rows: int = BLOCK) -> np.ndarray:
    """How many of each sample's ``n`` draws fall on a block of rows."""
    low, high = 0, -(-n // rows)
    draws = np.full(samples, n)
    while high - low > 1:
        middle = (low + high) // 2
        share = (middle - low) * rows / (min(high * rows, n) - low * rows)
        left = np.random.default_rng([seed, low, high]).binomial(draws, share)
        low, high, draws = (low, middle, left) if block < middle else (middle, high, draws - left)
    return draws


def _drawn_sums(n: int, samples: int, seed: int, rows: int):
    def run(table: pa.Table) -> pa.Table:
        idx, delta = table.column("idx").to_numpy(), table.column("delta").to_numpy()
        block = int(idx[0]) // rows
        delta = delta[np.argsort(idx)]
        draws = draws_of_block(n, block, samples, seed, rows)
        own = np.random.default_rng([seed, block])
        out, step = np.zeros(samples), max(1, CELLS // len(delta))
        for s in range(0, samples, step):
            counts = draws[s : s + step]
            ends = np.cumsum(counts)
            total = np.r_[0.0, np.cumsum(delta[own.integers(0, len(delta), int(ends[-1]))])]
            out[s : s + step] = total[ends] - total[ends - counts]
        return pa.table({"g": pa.array([0], pa.int32()), "at": pa.array([block], pa.int64()), "sum": pa.array([out], pa.list_(pa.float64()))})

    return run


def drawn_interval(values: DataFrame, samples: int = SAMPLES, confidence: float = 0.95, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """The same with exactly as many draws as there are values in every sample.

    ``values``: idx (from 0, without gaps), delta. The same rows and seed give the same draws, however the
    rows are partitioned.
    """
    n = values.count()
    rows = values.select(F.col("idx").cast("long").alias("idx"), F.col("delta").cast("double").alias("delta")).withColumn("block", F.floor(F.col("idx") / block))
    made = spread(rows, "block").groupBy("block").applyInArrow(_drawn_sums(n, samples, seed, block), "g int, at long, sum array<double>")
    found = summed(made, ["sum"]).select(F.transform("sum", lambda x: x / max(n, 1)).alias("s"))
    low, high = interval_ends(F.col("s"), confidence)
    return values.agg(F.avg("delta").alias("value")).join(found, F.lit(True), "left").select("value", low.alias("lower"), high.alias("upper"))


def _cell_sums(samples: int, wanted: dict[str, np.ndarray] | None):
    """Rows (g, example key, rater key, yes, n) to sums of the weighted answers; for ``wanted`` samples of some groups only."""

    def run(batches):
        from pyspark import TaskContext

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            groups = np.array(batch.column("g").to_pylist(), dtype=object)
            example, rater, yes, n = (batch.column(c).to_numpy() for c in ("example", "rater", "yes", "n"))
            for g in dict.fromkeys(groups.tolist()):
                places = np.arange(samples) if wanted is None else wanted.get(g)
                if places is None:
                    continue
                mine = np.flatnonzero(groups == g)
                total = sums.setdefault(g, np.zeros((2, len(places))))
                step = max(1, CELLS // len(places))
                raters, which = np.unique(rater[mine], return_inverse=True)
                few = poisson_weights(raters, places) if len(raters) <= step else None
                for s in range(0, len(mine), step):
                    rows = mine[s : s + step]
                    by_rater = few[which[s : s + step]] if few is not None else poisson_weights(rater[rows], places)
                    total += np.array([yes[rows], n[rows]], float) @ (poisson_weights(example[rows], places) * by_rater)
        for g, total in sums.items():
            yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.string()), "at": pa.array([TaskContext.get().partitionId()], pa.int64()), "yes": pa.array([total[0]], pa.list_(pa.float64())), "n": pa.array([total[1]], pa.list_(pa.float64()))})

    return run


def cluster_interval(judgments: DataFrame, first: str, second: str, by: str, samples: int = SAMPLES, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Per group the decisive rate with a two-way bootstrap over examples and raters.

    ``judgments``: the group (a few kinds, such as dimensions), example_id, rater_id, choice. In a sample an
    example and a rater have a Poisson weight each; an answer counts by their product. A sample without a decisive
    answer is drawn again, under the number that comes ``samples`` later, until it has one. Without any decisive
    answer the figures are null.
    """
    cells = judgments.groupBy(by, "example_id", "rater_id").agg(F.count_if(F.col("choice") == first).alias("yes"), F.count_if(F.col("choice").isin(first, second)).alias("n"))
    kind = cells.schema[by].dataType
    cells = materialized(cells)
    keyed = cells.where((F.col("n") > 0) & F.col(by).isNotNull()).select(F.col(by).cast("string").alias("g"), hash_key(seed, "example", F.col("example_id")).alias("example"), hash_key(seed, "rater", F.col("rater_id")).alias("rater"), "yes", "n")
    keyed = materialized(spread(keyed, "example"))
    schema = "g string, at long, yes array<double>, n array<double>"
    found = {r["g"]: (np.array(r["yes"]), np.array(r["n"])) for r in summed(keyed.mapInArrow(_cell_sums(samples, None), schema), ["yes", "n"]).collect()}
    for attempt in range(1, ATTEMPTS):
        empty = {g: np.flatnonzero(n == 0) for g, (_, n) in found.items()}
        empty = {g: x for g, x in empty.items() if len(x)}
        if not empty:
            break
        again = summed(keyed.mapInArrow(_cell_sums(samples, {g: x + attempt * samples for g, x in empty.items()}), schema), ["yes", "n"])
        for r in again.collect():
            for total, drawn in zip(found[r["g"]], (r["yes"], r["n"]), strict=True):
                total[empty[r["g"]]] = drawn
    spark = judgments.sparkSession
    rates = [(g, (yes[n > 0] / n[n > 0]).tolist()) for g, (yes, n) in found.items()]
    estimates = spark.createDataFrame(rates, "_g string, s array<double>").select(F.col("_g").cast(kind).alias("_g"), "s")
    low, high = interval_ends(F.col("s"), confidence)
    whole = cells.groupBy(by).agg((F.sum("yes") / F.nullif(F.sum("n"), F.lit(0))).alias("value"), F.count_distinct("example_id").alias("examples"), F.count_distinct("rater_id").alias("raters"))
    rate = F.col("value").isNotNull()
    return whole.join(F.broadcast(estimates), F.col(by) == F.col("_g"), "left").select(by, "value", F.when(rate, F.coalesce(low, "value")).alias("lower"), F.when(rate, F.coalesce(high, "value")).alias("upper"), "examples", "raters")


def sql_key(seed: int, name: str, x: str) -> str:
    """:func:`hash_key` for DuckDB."""
    return f"CAST('0x' || substr(md5('{seed}:{name}:' || {x}), 1, 8) AS BIGINT)"


def sql_mixed(rows: str, x: str) -> str:
    """A query: ``rows`` with ``x`` mixed."""
    for _ in range(2):
        rows = f"SELECT * REPLACE (xor({x}, {x} >> 16) * {FACTOR} & 4294967295 AS {x}) FROM ({rows})"
    return f"SELECT * REPLACE (xor({x}, {x} >> 16) AS {x}) FROM ({rows})"


def sql_weights(keys: str, samples: str) -> str:
    """A query: ``keys`` (key and more) with every b of the query ``samples`` and the weight ``w``, for DuckDB."""
    hashed = sql_mixed(f"SELECT b, b + 1 AS h FROM ({samples})", "h")
    once = sql_mixed(f"SELECT k.*, b, xor(key, h) AS x FROM ({keys}) k, ({hashed})", "x")
    twice = sql_mixed(f"SELECT * REPLACE (x + key & 4294967295 AS x) FROM ({once})", "x")
    return f"SELECT * EXCLUDE (x, key), {' + '.join(f'CAST(x >= {c} AS INT)' for c in STEPS)} AS w FROM ({twice})"
