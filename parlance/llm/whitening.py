"""Whitening of embeddings by a tall-skinny QR: the covariance is never formed to find its eigenvectors.

Every entry becomes a whole number, so sums and means are exact. The distinct rows are centred in their
partitions and each partition is reduced to its R factor; R factors are stacked and reduced again, a few at a
time, until one is left. With R = U S V', the columns of V are the eigenvectors of the covariance and S^2 / n its
eigenvalues. What the driver gets is one R factor and one vector of sums, whatever the number of rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import column, stored

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this, scaled, are set to it, so that sums of squares stay within doubles' whole numbers.
LARGEST = 1 << 46
COMPONENTS = 16
#: Partial results that one task merges, about.
FAN_IN = 16
#: Standard deviations below this share of the largest are rounding, not variance.
RANK = 1e-12


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def whole(e: Column) -> Column:
    """``floor(64 c) + 1000000`` for each entry, in longs; null for vectors that don't count."""
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    kept = lambda c: F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return F.when(finite & (F.size(e) > 0), F.transform(e, lambda c: F.floor(kept(c)).cast("long") + SHIFT))


def _merged(parts: DataFrame, merge, schema: str):
    """Partial results (``at`` long and more) merged FAN_IN at a time by an Arrow function until one row is left."""
    parts = stored(parts)
    n = parts.count()
    while n > 1:
        n = -(-n // FAN_IN)
        parts = stored(parts.withColumn("at", F.col("at") % n).groupBy("at").applyInArrow(merge, schema))
        n = parts.count()
    return parts.first()


def _sums(dims: int):
    def run(batches):
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0), dims)
                # halves of the bits are summed apart: no sum can overflow
                high, low = x >> 24, x & 0xFFFFFF
                yield pa.RecordBatch.from_pydict({"pos": np.arange(dims), "n": np.full(dims, len(x)), "high": high.sum(axis=0), "low": low.sum(axis=0)})

    return run


def exact_sums(x: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows, and the sum of each dimension, as exact integers."""
    parts = x.mapInArrow(_sums(dims), "pos long, n long, high long, low long")
    got = parts.groupBy("pos").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).collect()
    got.sort(key=lambda r: r["pos"])
    return (int(got[0]["n"]) if got else 0), [(int(r["high"]) << 24) + int(r["low"]) for r in got]


class Centre:
    """Subtracts the exact mean: the rounded mean is a whole number and a rest below one."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([float(Fraction(s % n, n)) for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n x - S)^2``, exact; None where it doesn't fit a long."""
        rest = np.array([s % self.n for s in self.sums], dtype=object)
        apart = np.abs(x - self.base).max(initial=0) + 1
        if apart * self.n < math.isqrt((1 << 62) // x.shape[1]):
            d = (x - self.base) * self.n - rest.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = (x - self.base).astype(object) * self.n - rest
        return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def _upper(stacked: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stacked, mode="r")


def _packed(at: int, r: np.ndarray) -> dict:
    return {"at": pa.array([at], pa.int64()), "rows": pa.array([len(r)], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))}


def _factors(centre: Centre, dims: int):
    def run(batches):
        from pyspark import TaskContext

        r = np.empty((0, dims))
        for batch in batches:
            if len(batch):
                r = _upper(np.vstack([r, centre(_matrix(batch.column(0), dims))]))
        if len(r):
            yield pa.RecordBatch.from_pydict(_packed(TaskContext.get().partitionId(), r))

    return run


def _stack(dims: int):
    def run(table: pa.Table) -> pa.Table:
        at = table.column("at")[0].as_py()
        return pa.table(_packed(at, _upper(np.vstack([np.array(v).reshape(-1, dims) for v in table.column("r").to_pylist()]))))

    return run


class Whitening:
    """A fitted map: ``n`` rows, exact sums, axes (dims x components) and the share of variance of each."""

    def __init__(self, centre: Centre, values: np.ndarray, axes: np.ndarray, total: float):
        self.centre, self.axes, self.n = centre, axes / np.sqrt(values), centre.n
        self.explained = values / total

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ self.axes


def fit(x: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """From a stored column of distinct whole-numbered vectors; None without rows. Components without variance are left out."""
    n, sums = exact_sums(x, dims)
    if not n:
        return None
    centre = Centre(n, sums)
    got = _merged(x.mapInArrow(_factors(centre, dims), "at long, rows long, r array<double>"), _stack(dims), "at long, rows long, r array<double>")
    _, s, vt = np.linalg.svd(np.array(got["r"]).reshape(-1, dims))
    rank = int((s > max(s[0], 1e-9) * RANK).sum()) if len(s) else 0
    k = min(components, rank)
    values = s * s / n
    return Whitening(centre, values[:k], vt[:k].T, float(values.sum()) or 1.0)


def _moments(model: Whitening, dims: int, k: int):
    def run(batches):
        from pyspark import TaskContext

        found = None
        for batch in batches:
            if len(batch):
                w = model(_matrix(batch.column(0), dims))
                mean = w.mean(axis=0)
                part = (len(w), mean, (w - mean).T @ (w - mean))
                found = part if found is None else _joined(found, part)
        if found:
            yield pa.RecordBatch.from_pydict(_packed_moments(TaskContext.get().partitionId(), *found))

    return run


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two sets of rows together."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _packed_moments(at: int, n: int, mean: np.ndarray, products: np.ndarray) -> dict:
    return {"at": pa.array([at], pa.int64()), "n": pa.array([n], pa.int64()), "mean": pa.array([mean], pa.list_(pa.float64())), "products": pa.array([products.ravel()], pa.list_(pa.float64()))}


def _join_moments(k: int):
    def run(table: pa.Table) -> pa.Table:
        found = None
        for r in table.to_pylist():
            part = (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k))
            found = part if found is None else _joined(found, part)
        return pa.table(_packed_moments(table.column("at")[0].as_py(), *found))

    return run


def identity_error(x: DataFrame, model: Whitening, dims: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k = model.axes.shape[1]
    if not k:
        return 0.0
    schema = "at long, n long, mean array<double>, products array<double>"
    got = _merged(x.mapInArrow(_moments(model, dims, k), schema), _join_moments(k), schema)
    return float(np.abs(np.array(got["products"]).reshape(k, k) / got["n"] - np.eye(k)).max())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(model: Whitening, dims: int, error: float):
    def run(batches):
        k = model.axes.shape[1]
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            m = len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            each = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n, np.int64)]
            deviations = pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            rest = [model(x).ravel(), np.tile(model.explained, m), np.full(m * k, error)]
            arrays = [ids, *map(pa.array, each), deviations, *map(pa.array, rest)]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Vectors that are null, empty or hold null or non-finite entries are dropped, and so are those that are not as
    long as most (of lengths equally frequent the largest counts). Repeated vectors count once in the fit and come
    back as often as they came, under their ids, null ones too. Components without variance are left out, so equal
    vectors only, or an empty table, give no rows. ``deviation`` is null where it exceeds a long. Entries beyond
    2^40 in size are cut to that. Further columns are ignored.
    """
    from pyspark.sql.types import StructField, StructType

    spark = vectors.sparkSession
    e = column(vector_col).cast("array<double>")
    rows = vectors.select(column(id_col).alias("vec_id"), whole(e).alias("x")).where("x IS NOT NULL")
    schema = StructType([StructField("vec_id", rows.schema["vec_id"].dataType), *StructType.fromDDL(OUT).fields])
    most = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    dims = most["dims"]
    rows = rows.where(F.size("x") == dims)
    distinct = stored(rows.select("x").distinct())
    model = fit(distinct, dims, components)
    error = identity_error(distinct, model, dims)
    return rows.mapInArrow(_whitened(model, dims, error), schema)
