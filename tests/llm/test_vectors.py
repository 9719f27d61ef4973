"""Near-duplicate vectors and whitening against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from oracle import connect, same

from parlance.llm import embeddups, whitening
from parlance.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "node string, vec_id long, cell int, embedding array<float>, label int, u int, home string, key long, `a.b` int"


def rows(vectors):
    """(vec_id, embedding, label) with columns that clash with the operators' own."""
    return [("n", i, 1, e, label, 2, "h", 3, 4) for i, e, label in vectors]


def crowd(seed=5, n=400, dims=12):
    """Vectors of three labels: loose ones, chains of near ones, copies, scaled copies and odd ones."""
    rng = np.random.default_rng(seed)
    out = [(i, rng.normal(size=dims).tolist(), int(rng.integers(3))) for i in range(n)]
    base = rng.normal(size=dims)
    for i in range(n, n + 150):  # a chain: each is near the one before
        base = base + rng.normal(size=dims) * 0.05 * np.linalg.norm(base) / math.sqrt(dims) * rng.uniform(0.5, 3.5)
        out.append((i, base.tolist(), 1))
    for i in range(n + 150, n + 200):
        out.append((i, out[7][1], out[7][2]))
        out.append((i + 1000, [2 * x for x in out[8][1]], out[8][2]))
    odd = [None, [], [0.0] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0, 2.0], [1.0, 2.0], [-0.0] + [1.0] * (dims - 1), [0.0] + [1.0] * (dims - 1)]
    out += [(5000 + i, e, 1) for i, e in enumerate(odd)]
    out += [(6000, out[0][1], None), (6001, out[0][1], None), (None, out[1][1], out[1][2]), (None, None, 1), (3, out[3][1], out[3][2])]
    return out


def brute_groups(vectors, cosine=0.98):
    def unit(e):
        if not e or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            return None
        x = np.array(e, np.float32).astype(float)
        return x / math.sqrt(float(x @ x))

    units = [unit(e) for _, e, _ in vectors]
    links, root = [set() for _ in vectors], list(range(len(vectors)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, _, a) in enumerate(vectors):
        for j in range(i):
            if a is not None and a == vectors[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= cosine:
                links[i].add(j)
                links[j].add(i)
                root[find(i)] = find(j)
    smallest = {}
    for i, (v, _, _) in enumerate(vectors):
        if v is not None:
            smallest[find(i)] = min(v, smallest.get(find(i), v))
    return sorted((v if v is not None else -1, len(links[i]), c if (c := smallest.get(find(i))) is not None else -1, v == smallest.get(find(i))) for i, (v, _, _) in enumerate(vectors))


def found(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["component_id"] is not None else -1, r["kept"]) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"cell_rows": 40, "max_homes": 30}, {"cell_rows": 40, "max_homes": 30, "block": 17}])
def test_groups_against_all_pairs(spark, options):
    vectors = crowd()
    df = spark.createDataFrame(rows(vectors), SCHEMA)
    assert found(embeddups.embedding_groups(df, **options)) == brute_groups(vectors)


def test_groups_of_whole_table(spark, sf_dir):
    con = connect(sf_dir)
    same(QUERIES["op11_embedding_dedup"](spark, sf_dir), con, ORACLE_SQL["op11_embedding_dedup"])


def test_empty_and_kept_rows(spark):
    vectors = crowd(n=60)
    df = spark.createDataFrame(rows(vectors), SCHEMA)
    assert embeddups.embedding_groups(df.limit(0)).collect() == []
    keep = {r[0] for r in brute_groups(vectors) if r[3]}
    left = embeddups.near_dedup(df)
    assert left.columns == df.columns
    assert {r["vec_id"] if r["vec_id"] is not None else -1 for r in left.collect()} == keep


def test_products_keep_components():
    """A forest has the components of the links it stands for."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        near = rng.random((15, 20)) < 0.07
        r, c = np.nonzero(near)
        if not len(r):
            continue
        low_r, low_c = embeddups._forest(r, c, 15, 20)
        both = np.zeros((35, 35), bool)
        both[r, 15 + c] = both[15 + c, r] = True
        reach = np.linalg.matrix_power((both | np.eye(35, dtype=bool)).astype(float), 40) > 0
        want = [int(np.flatnonzero(reach[i, :15]).min()) if reach[i, :15].any() else 15 for i in range(35)]
        assert want == [*low_r.tolist(), *low_c.tolist()]


def brute_whitening(vectors, components=16):
    """Whole numbers, exact sums, eigenvectors of the covariance itself."""
    dims = max(map(len, (e for _, e, _ in vectors if e)))
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for i, e, _ in vectors if e and len(e) == dims and all(c is not None and math.isfinite(c) for c in e)]
    x = sorted({tuple(v) for _, v in kept})
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in x], float) / n
    values, axes = np.linalg.eigh(d.T @ d / n)
    order = np.argsort(-values)[:components]
    keep = [i for i in order if values[i] > 1e-9]
    return n, sums, kept, values[keep], axes[:, keep], values.sum()


def check_whitening(got, vectors):
    n, sums, kept, values, axes, total = brute_whitening(vectors)
    got = sorted(got, key=lambda r: (r["vec_id"] if r["vec_id"] is not None else -1, r["component"]))
    k = len(values)
    assert len(got) == len(kept) * k and k > 0
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    signs = None
    for i, x in kept:
        d = np.array([n * c - s for c, s in zip(x, sums, strict=True)], float) / n
        want = d @ axes / np.sqrt(values)
        mine = [by[i][c + 1] for c in range(k)]
        have = np.array([m[0]["whitened"] for m in mine])
        if signs is None:
            signs = np.sign(have * want)
        assert all(m[0]["n"] == n and m[0]["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for m in mine)
        if i not in (None, 3):
            assert np.allclose(have, want * signs, atol=1e-6)
        assert np.allclose([m[0]["explained"] for m in mine], values / total, rtol=1e-9)
        assert all(0 <= m[0]["identity_error"] < 1e-9 for m in mine)


def test_whitening_against_covariance(spark):
    vectors = crowd()
    df = spark.createDataFrame(rows(vectors), SCHEMA)
    check_whitening(whitening.whiten(df.repartition(23)).collect(), vectors)


def test_whitening_merges_many_parts(spark):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(700, 9)) * 50).astype(int) + 1_000_000
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(100)
    model, d = whitening.fit(df, 9), x - x.mean(axis=0)
    values = np.linalg.eigvalsh(d.T @ d / 700)[::-1]
    assert model.n == 700 and np.allclose(model.explained, values / values.sum(), rtol=1e-9)
    assert whitening.identity_error(df, model, 9) < 1e-9


def test_whitening_of_whole_table(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check_whitening(QUERIES["op12_whitening"](spark, sf_dir).collect(), [(r["vec_id"], r["embedding"], r["label"]) for r in t])


def test_whitening_at_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    same_rows = spark.createDataFrame(rows([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, None, 0)]), SCHEMA)
    assert whitening.whiten(same_rows).collect() == []
    flat = spark.createDataFrame(rows([(i, [float(i), 5.0], 0) for i in range(5)]), SCHEMA)
    got = whitening.whiten(flat).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 5 and abs(got[0]["explained"] - 1) < 1e-12
    huge = spark.createDataFrame(rows([(1, [1e30, 2.0], 0), (2, [-1e30, 2.0], 0), (3, [1.0, 2.0], 0)]), SCHEMA)
    assert {r["deviation"] for r in whitening.whiten(huge).where("vec_id < 3").collect()} == {None}
