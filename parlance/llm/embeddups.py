"""Near-duplicate vectors: spherical k-means deals them to cells, cosines are blocked matrix products within cells.

Equal vectors are one node with a count. Every node has one home cell, that of its nearest centroid, and is a
guest in every other cell that may hold a partner: two unit vectors with cosine s are ``sqrt(2 - 2 s)`` apart at
most, so a partner of x with home c has ``x.(c1 - c) <= reach |c1 - c|``, c1 being x's own centroid. A home
compared with the homes and guests of its cell has thus met all its partners once, and no link is lost.

Cells stay too large where vectors are many or alike: these are dealt to sub-cells again while a sample says that
it pays. Whatever is left is compared block by block, so a task holds two blocks, whatever the cell's size. A
product gives, for each row, how many it is linked with, and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import column, components, stored

COSINE = 0.98
#: Nodes for each cell that a level aims at, and cells that one level makes of a cell at most.
CELL_ROWS, MAX_CELLS = 512, 64
#: Nodes of a cell by whose vectors its centroids are fitted, in expectation (drawn by hashes).
SAMPLE = 4096
#: Homes beyond which a cell is dealt again, and levels at most.
MAX_HOMES, LEVELS = 16_384, 4
#: Rows of a block, and of a strip of its product.
BLOCK, STRIP = 4096, 256
ROUNDS = 8


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def usable(e: Column) -> Column:
    """Vectors with a direction: not null, finite components only, not all zero."""
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    return F.coalesce(finite & F.exists(e, lambda c: c != 0), F.lit(False))


def _units(batches):
    for batch in batches:
        out = []
        for v in batch.column("e"):
            x = np.array(v.values.to_numpy(zero_copy_only=False))
            x /= np.abs(x).max()
            out.append(x / math.sqrt(float(x @ x)))
        names = [n for n in batch.schema.names if n != "e"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, "u"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors; starts from vectors far from one another."""
    centres = [x[0]]
    near = x @ x[0]
    for _ in range(k - 1):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), c)
    return c


def _cells_of(u: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and which cells it has to be in."""
    near = u @ c.T
    own = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T)))
    member = near[np.arange(len(u)), own][:, None] - near <= reach * apart[own] + 1e-9
    return own, member


def _fitter(reach: float, always: bool):
    def fit(table: pa.Table) -> pa.Table:
        cell, k = table.column("cell")[0].as_py(), table.column("k")[0].as_py()
        u = matrix(table.column("u"))
        c = spherical_kmeans(u, min(k, len(u)))
        if not always:
            own, member = _cells_of(u, c, reach)
            work = (np.bincount(own, minlength=len(c)) * member.sum(axis=0)).sum() / len(u) ** 2
            if work > 0.5:
                c = c[:0]  # most would meet most again: blocks do that cheaper
        flat = pa.array([c.ravel()], pa.list_(pa.float64()))
        return pa.table({"cell": pa.array([cell]), "c": flat})

    return fit


def _assigner(reach: float):
    def assign(rows: pa.Table, centres: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({"cell": pa.array([], pa.string()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "home": pa.array([], pa.bool_()), "u": pa.array([], pa.list_(pa.float64()))})
        u = matrix(rows.column("u"))
        c = matrix(centres.column("c")).reshape(-1, u.shape[1])
        own, member = _cells_of(u, c, reach)
        at, cell = np.nonzero(member)
        parent = rows.column("cell")[0].as_py()
        taken = rows.take(pa.array(at))
        home = taken.column("home").to_numpy() & (own[at] == cell)
        return pa.table({"cell": pa.array([f"{parent}/{x}" for x in cell.tolist()], pa.string()), "node": taken.column("node"), "n": taken.column("n"), "home": pa.array(home), "u": taken.column("u")})

    return assign


ROWS = "cell string, node long, n long, home boolean, u array<double>"


def _deal(rows: DataFrame, big: DataFrame, reach: float, always: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of the cells in ``big`` dealt to sub-cells, and the names of the cells that were."""
    there = rows.join(big, "cell")
    drawn = F.pmod(F.xxhash64(F.lit("drawn"), "node"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    fitted = there.where("home").where(drawn).select("cell", "k", "u").groupBy("cell").applyInArrow(_fitter(reach, always), "cell string, c array<double>")
    centres = stored(fitted.where(F.size("c") > 0))
    names = centres.select("cell")
    blocks = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
    right = centres.join(big.select("cell", "blocks"), "cell").select("cell", F.explode(blocks).alias("block"), "c")
    left = there.join(names, "cell", "left_semi").withColumn("block", F.pmod(F.xxhash64(F.lit("dealt"), "node"), "blocks").cast("int"))
    dealt = left.select("cell", "block", "node", "n", "home", "u").groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(_assigner(reach), ROWS)
    return dealt, names


def cells(nodes: DataFrame, reach: float, cell_rows: int = CELL_ROWS, max_homes: int = MAX_HOMES) -> DataFrame:
    """From nodes (cell, node, n, home, u), all at home, the rows of the final cells, guests included."""
    rows, done = nodes, None
    for level in range(LEVELS):
        sizes = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
        k = F.least(F.lit(MAX_CELLS), F.ceil(F.col("homes") / cell_rows)).cast("int").alias("k")
        big = stored(sizes.where(F.col("homes") > (cell_rows if level == 0 else max_homes)).select("cell", k, (SAMPLE / F.col("homes")).alias("share"), F.ceil(F.col("all") / BLOCK).alias("blocks")))
        if big.isEmpty():
            break
        dealt, names = _deal(rows, big, reach, always=level == 0)
        settled = rows.join(names, "cell", "left_anti")
        done = settled if done is None else done.union(settled)
        rows = stored(dealt)
    return rows if done is None else done.union(rows)


def _forest(r: np.ndarray, c: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest row that each row and each column is connected with through the links (r, c), r ascending.

    Columns without a link get ``rows``.
    """
    low_r, low_c = np.arange(rows), np.full(cols, rows)
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    linked = r[starts]
    while True:
        np.minimum.at(low_c, c, low_r[r])
        new = low_r.copy()
        new[linked] = np.minimum.reduceat(low_c[c], starts)
        if (new == low_r).all():
            return low_r, low_c
        low_r = new


def _products(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        u, node, n = matrix(table.column("u")), table.column("node").to_numpy(), table.column("n").to_numpy()
        left, right = np.flatnonzero(table.column("is_left").to_numpy()), np.flatnonzero(table.column("is_right").to_numpy())
        others, weight, ids = np.ascontiguousarray(u[right].T), n[right].astype(float), node[right]
        place = {x: i for i, x in enumerate(ids.tolist())}
        a, b, links = [], [], []
        for s in range(0, len(left), STRIP):
            part = left[s : s + STRIP]
            near = u[part] @ others >= cosine
            for i, x in enumerate(node[part].tolist()):
                if x in place:
                    near[i, place[x]] = False
            r, c = np.nonzero(near)
            if not len(r):
                continue
            got = near @ weight
            hit = np.flatnonzero(got)
            a.append(node[part][hit])
            b.append(np.full(len(hit), -1))
            links.append(got[hit].astype(np.int64))
            low_r, low_c = _forest(r, c, len(part), len(right))
            for ids_of, low in ((node[part], low_r), (ids, low_c)):
                at = np.flatnonzero(low < len(part))
                to = node[part][low[at]]
                other = ids_of[at] != to
                a.append(ids_of[at][other])
                b.append(to[other])
                links.append(np.zeros(other.sum(), np.int64))
        made = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b, links)]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("a", "b", "links"), made, strict=True)})

    return run


def compared(members: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Products of all cells: rows (a, -1, links of a) and edges (a, b, 0) of spanning forests."""
    sizes = members.groupBy("cell").agg(F.ceil(F.count_if("home") / block).cast("int").alias("across"), F.ceil(F.count("*") / block).cast("int").alias("down"))
    rows = members.join(sizes.where("across > 0"), "cell")
    own_left = F.pmod(F.xxhash64(F.lit("left"), "node"), "across").cast("int")
    own_right = F.pmod(F.xxhash64(F.lit("right"), "node"), "down").cast("int")
    rows = rows.withColumn("i", own_left).withColumn("j", own_right)
    task = lambda i, j, is_left, is_right: F.struct(i.alias("i"), j.alias("j"), is_left.alias("is_left"), is_right.alias("is_right"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda j: task(F.col("i"), j, F.lit(True), j == F.col("j")))
    as_right = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda i: task(i, F.col("j"), F.lit(False), F.lit(True)))
    elsewhere = F.filter(as_right, lambda t: ~F.col("home") | (t["i"] != F.col("i")))
    tasks = F.explode(F.when(F.col("home"), F.concat(as_left, elsewhere)).otherwise(elsewhere)).alias("t")
    dealt = rows.select("cell", "node", "n", "u", tasks).select("cell", "t.i", "t.j", "node", "n", "u", "t.is_left", "t.is_right")
    return dealt.groupBy("cell", "i", "j").applyInArrow(_products(cosine), "a long, b long, links long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, reach: float = 1.0, cell_rows: int = CELL_ROWS, max_homes: int = MAX_HOMES, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows are linked when labels are equal and not null, vectors have the same length, and their cosine in
    double precision is ``cosine`` at least. ``reach`` 1 loses no link; smaller values make fewer guests and
    may lose links whose vectors differ just across a border between cells. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing and stay. Repeated rows count as links of one
    another. ``component_id`` is the smallest id that is not null; it is null only if none of the component
    has an id, and such rows are kept. An empty table gives an empty result; further columns are ignored.
    """
    e = F.col("e")
    # adding zero turns -0.0 into 0.0, so that equal vectors are equal keys
    plain = F.transform(column(vector_col).cast("array<double>"), lambda c: c + F.lit(0.0))
    rows = vectors.select(column(id_col).alias("vec_id"), column(label_col).alias("label"), plain.alias("e"))
    fit = usable(e) & F.col("label").isNotNull()
    distinct = rows.where(fit).groupBy("label", "e").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()))
    kinds = stored(distinct.groupBy("label", F.size("e").alias("size")).agg(F.lit(1).alias("one")).select("label", "size", F.monotonically_increasing_id().cast("string").alias("cell")))
    placed = distinct.join(kinds, (distinct.label == kinds.label) & (F.size(distinct.e) == kinds["size"])).select("cell", "node", "n", F.lit(True).alias("home"), distinct.e)
    nodes = stored(placed.mapInArrow(_units, ROWS))
    made = stored(compared(cells(nodes, reach * math.sqrt(max(0.0, 2 - 2 * cosine)), cell_rows, max_homes), cosine, block))
    links = made.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(made.where("b >= 0").select("a", "b"))
    joined = distinct.join(links, "node", "left").join(roots, "node", "left")
    known = stored(joined.select("label", "e", "first_id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = stored(known.join(smallest, "root").select("label", "e", "n_links", "component_id", F.xxhash64("label", "e").alias("key")))
    own = rows.withColumn("key", F.when(fit, F.xxhash64("label", "e")))
    met = own.join(final, (own.key == final.key) & (own.label == final.label) & (own.e == final.e), "left")
    component = F.when(final.key.isNull(), own.vec_id).otherwise(final.component_id)
    return met.select(own.vec_id, F.coalesce(final.n_links, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), own.vec_id.eqNullSafe(component).alias("kept"))


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """The caller's rows that stay, one of each group, by ``embedding_groups``; rows that repeat an id all stay or go."""
    keep = embedding_groups(vectors, id_col, vector_col, label_col, **options).where("kept").select(F.col("vec_id").alias("_keep")).distinct()
    return vectors.join(keep, column(id_col).eqNullSafe(F.col("_keep")), "left_semi")


#: All pairs of equal label; components as the closure of the links.
ORACLE_SQL = """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS r FROM embeddings
    ), pairs AS (
      SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r
      WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98
    ), reach(r, node) AS (
      SELECT r, r FROM v UNION SELECT reach.r, pairs.b FROM reach JOIN pairs ON pairs.a = reach.node
    ), root AS (
      SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.node GROUP BY reach.r
    ), links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
    SELECT v.vec_id, coalesce(links.n, 0) AS n_links, root.component_id, v.vec_id = root.component_id AS kept
    FROM v JOIN root USING (r) LEFT JOIN links ON links.a = v.r
"""
