"""Embedding near-dedup with an inverted multi-index.

Index: vectors are scaled to length one and halved; each half has its own codebook, fitted by
k-means on a bounded, hash-chosen sample (``SAMPLE`` rows, or 16 for each centroid).  The pair
of nearest centroids is a vector's cell in the product grid, and every vector is in it.

Search: a vector's multi-sequence traversal visits cells in the order of the summed distances
of their two centroids.  How many cells are visited is calibrated: hash-chosen vectors are
compared with all rows by brute force, in rounds until ``LINKED`` of them with few links are
found.  The number is the smallest by which a vector has met ``recall`` of its links on average,
for vectors of few links and of many each, and ``LEAST_CELLS`` at least; where no vector asked
has a link, all cells are visited.  Pairs met are verified by their cosine in double precision,
so no link is below the threshold.

Equal vectors of a label are one class throughout and count as often as they occur.  Vectors
meet in stripes (label, first centroid), which are cut into tiles of at most about ``TILE``
members and ``TILE`` visitors, so a dense group is many small matrix products.  A tile returns
for each of its vectors the number of links and the smallest vector connected within the
tile, never the pairs.  A link found from one side only is counted for both.

Defined cases: rows whose label, vec_id or vector is null, whose vector is empty, all zero, or
holds nulls or non-finite numbers link with nothing and are their own component; vectors of
different lengths never link; repeated rows count as vectors of their own; an empty table
gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, ship

SAMPLE = 8192
QUERIES = 512
MOST_QUERIES = 16_384
LINKED = 300
STRATUM = 4
CELL_ROWS = 32
LEAST_CELLS = 8
MOST_CENTROIDS = 4096
TILE = 1024
ROUNDS = 10
NEAR_VALUES = 1 << 22   # distances computed at once


def usable(vec_id: Column, label: Column, vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & (F.size(vector) > 0) & fine
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)        # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * x @ c.T + (c * c).sum(axis=1), 0.0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The closest centroid of each row, some thousand rows at a time."""
    step = max(1, NEAR_VALUES // len(c))
    return np.concatenate([squared(x[i:i + step], c).argmin(axis=1) for i in range(0, len(x), step)])


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids from evenly spaced starts; an empty cluster keeps its centroid."""
    c = x[np.unique(np.linspace(0, len(x) - 1, min(k, len(x))).astype(int))].copy()
    for _ in range(ROUNDS):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        for col in range(x.shape[1]):
            s = np.bincount(near, x[:, col], len(c))
            c[n > 0, col] = s[n > 0] / n[n > 0]
    return c


class Codebooks:
    """By vector length: centroids of the first and of the second half."""

    def __init__(self, samples: dict[int, np.ndarray], k: int):
        self.books = {}
        for dim, x in samples.items():
            h = (dim + 1) // 2
            self.books[dim] = (k_means(x[:, :h], k), k_means(x[:, h:], k) if dim > 1 else np.zeros((1, 0)))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the centroids of both halves; a length without codebooks has one cell."""
        c1, c2 = self.books.get(x.shape[1], (None, None))
        if c1 is None:
            return np.zeros((len(x), 1)), np.zeros((len(x), 1))
        h = (x.shape[1] + 1) // 2
        return squared(x[:, :h], c1), squared(x[:, h:], c2)

    def grid(self, dim: int) -> tuple[int, int]:
        c1, c2 = self.books.get(dim, ([0], [0]))
        return len(c1), len(c2)

    def traverse(self, x: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """Multi-sequence order: the first ``cells`` cells (i, j) of every row by summed distance; -1 past the last.

        Row i of the grid (sorted by its centroid's distance) keeps a pointer to its next column;
        each step takes the cheapest pointer and moves it on, for all vectors at once."""
        d1, d2 = self.halves(x)
        n1, n2 = min(cells, d1.shape[1]), d2.shape[1]
        o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
        s1 = np.take_along_axis(d1, o1, axis=1)[:, :n1]
        s2 = np.append(np.take_along_axis(d2, o2, axis=1), np.full((len(x), 1), np.inf), axis=1)
        pointer = np.zeros((len(x), n1), np.int64)
        rows = np.arange(len(x))
        out1, out2 = np.full((len(x), cells), -1, np.int32), np.full((len(x), cells), -1, np.int32)
        cost = s1 + s2[:, :1]
        for t in range(min(cells, n1 * n2)):
            i = cost.argmin(axis=1)
            j = pointer[rows, i]
            out1[:, t], out2[:, t] = o1[rows, i], o2[rows, np.minimum(j, n2 - 1)]
            pointer[rows, i] = j + 1
            cost[rows, i] = s1[rows, i] + s2[rows, j + 1]
        return out1, out2


def by_length(col: pa.Array):
    """(rows, matrix) of each vector length in an Arrow list column."""
    offs = col.offsets.to_numpy()
    values = col.values.to_numpy(zero_copy_only=False)
    size = np.diff(offs)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield at, values[offs[:-1][at][:, None] + np.arange(dim)]


def by_label(labels: np.ndarray):
    """(label, rows) of each label in an array of them."""
    names, at = np.unique(labels, return_inverse=True)
    order = np.argsort(at, kind="stable")
    return zip(names.tolist(), np.split(order, np.cumsum(np.bincount(at))[:-1]), strict=True)


def fit(classes: DataFrame, n: int) -> Codebooks:
    """Codebooks for ``n`` classes, from a sample of them of bounded size."""
    k = int(np.clip(round((n / CELL_ROWS) ** 0.5), 2, MOST_CENTROIDS))
    want = max(SAMPLE, 16 * k)
    at = F.pmod(F.xxhash64(F.lit("fit"), "rep"), F.lit(1_000_003))
    rows = classes.where(at < int(min(1.0, want / max(n, 1)) * 1_000_003) + 1).select("rep", "vec").orderBy("rep").toArrow()
    if not rows.num_rows:
        return Codebooks({}, k)
    return Codebooks({m.shape[1]: unit_rows(m) for _, m in by_length(rows["vec"].combine_chunks())}, k)


def asked_links(classes: DataFrame, books: Codebooks, threshold: float, asked: pa.Table) -> DataFrame:
    """(query, rank, n): of the asked vectors, by brute force against all rows, how many links lie in the cell of
    which rank in the query's traversal."""
    held = {}
    labels, reps = np.array(asked["label"].to_pylist(), object), asked["rep"].to_numpy()
    for rows, m in by_length(asked["vec"].combine_chunks()):
        for label, own in by_label(labels[rows]):
            held[m.shape[1], label] = unit_rows(m[own]), reps[rows][own]
    schema = pa.schema([("query", pa.int64()), ("rank", pa.int64()), ("n", pa.int64())])

    def met(x, qr, y, r):
        q, at = np.nonzero((x @ y.T >= threshold) & (qr[:, None] != r[None, :]))
        if not len(q):
            return
        d1, d2 = books.halves(y[at])
        cell, count = np.unique(np.stack([q, d1.argmin(axis=1), d2.argmin(axis=1)], axis=1), axis=0, return_counts=True)
        some, k = np.unique(cell[:, 0], return_inverse=True)
        q1, q2 = books.halves(x[some])
        order = np.sort(q2, axis=1)
        ranks = [int(np.searchsorted(order[a], q1[a, i] + q2[a, j] - q1[a], "left").sum())
                 for a, i, j in zip(k.ravel().tolist(), cell[:, 1].tolist(), cell[:, 2].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(qr[cell[:, 0]]), pa.array(ranks, pa.int64()), pa.array(count, pa.int64())],
                                         schema=schema)

    def run(batches):
        for b in batches:
            label, rep = np.array(b.column(1).to_pylist(), object), b.column(0).to_numpy()
            for rows, m in by_length(b.column(2)):
                for name, own in by_label(label[rows]):
                    if (m.shape[1], name) not in held:
                        continue
                    x, qr = held[m.shape[1], name]
                    y, r = unit_rows(m[own]), rep[rows][own]
                    for i in range(0, len(y), TILE):
                        for j in range(0, len(x), TILE):
                            yield from met(x[j:j + TILE], qr[j:j + TILE], y[i:i + TILE], r[i:i + TILE])

    return ship(classes).select("rep", "label", "vec").mapInArrow(run, "query long, rank long, n long") \
        .groupBy("query", "rank").agg(F.sum("n").alias("n"))


def calibrate(classes: DataFrame, books: Codebooks, n: int, threshold: float, recall: float) -> int | None:
    """Cells to visit: the rank by which the asked vectors have met ``recall`` of their links, averaged over vectors
    with about as many links (a factor of ``STRATUM``), in the group that needs the most; None for all cells.

    Hash-chosen vectors are asked in rounds until ``LINKED`` with less than ``STRATUM`` links are found, or
    ``MOST_QUERIES`` or all are asked; without any link, nothing is known and all cells are visited."""
    at = F.pmod(F.xxhash64(F.lit("ask"), "rep"), F.lit(1_000_000_007))
    weights: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))    # by stratum and rank
    linked: dict[int, int] = defaultdict(int)
    below, want = 0, QUERIES
    while True:
        upto = int(min(1.0, want / max(n, 1)) * 1_000_000_007) + 1
        asked = classes.where((at >= below) & (at < upto)).select("rep", "label", "vec").toArrow()
        if asked.num_rows:
            found = cut(asked_links(classes, books, threshold, asked))
            total = found.groupBy("query").agg(F.sum("n").alias("total"))
            stratum = F.floor(F.log(float(STRATUM), "total") + F.lit(1e-9)).cast("int")
            for r in total.groupBy(stratum.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect():
                linked[r.s] += r.n
            for r in found.join(total, "query").groupBy(stratum.alias("s"), "rank").agg(F.sum(F.col("n") / F.col("total")).alias("w")).collect():
                weights[r.s][r["rank"]] += r.w
        if want >= min(n, MOST_QUERIES) or linked.get(0, 0) >= LINKED:
            break
        below, want = upto, min(8 * want, MOST_QUERIES)
    if not linked:
        return None
    most = LEAST_CELLS
    for s, by_rank in weights.items():
        seen = 0.0
        for rank in sorted(by_rank):
            seen += by_rank[rank]
            if seen >= recall * linked[s] - 1e-6:
                break
        most = max(most, rank + 1)
    return most


def place(books: Codebooks, cells: int | None):
    """mapInArrow function: classes to one row as a member of its stripe, and one as a visitor of each stripe
    (first centroid) that its traversal meets.  Where all cells are visited, their lists are left empty."""
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("stripe", pa.int32()), ("member", pa.bool_()),
                        ("rep", pa.int64()), ("n", pa.int64()), ("vec", pa.list_(pa.float64())), ("i", pa.int32()),
                        ("j", pa.int32()), ("is", pa.list_(pa.int32())), ("js", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            rep, label, n = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(3).to_numpy()
            for rows, m in by_length(b.column(2)):
                n1, n2 = books.grid(m.shape[1])
                whole = cells is None or cells >= n1 * n2
                for part in np.array_split(np.arange(len(rows)), -(-len(rows) // 2048)):
                    x = unit_rows(m[part])
                    c1, c2 = books.traverse(x, 1 if whole else cells)
                    out = [[] for _ in schema]
                    for k, r in enumerate(rows[part].tolist()):
                        own = (int(c1[k, 0]), int(c2[k, 0]))
                        a, z = c1[k][c1[k] >= 0], c2[k][c1[k] >= 0]
                        lead = (label[r], m.shape[1])
                        tail = (int(rep[r]), int(n[r]), x[k], *own)
                        if whole:
                            a = z = a[:0]
                        for y, s in zip(out, (*lead, own[0], True, *tail, a, z), strict=True):
                            y.append(s)
                        for stripe in range(n1) if whole else np.unique(a).tolist():
                            hit = a == stripe
                            for y, s in zip(out, (*lead, stripe, False, *tail, a[hit], z[hit]), strict=True):
                                y.append(s)
                    yield pa.RecordBatch.from_arrays([pa.array(y, f.type) for y, f in zip(out, schema, strict=True)], schema=schema)

    return run


STRIPE_ROWS = "label string, dim int, stripe int, member boolean, rep long, n long, vec array<double>, i int, j int, is array<int>, js array<int>"


def forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest node number connected to each of ``size`` nodes by the links (a, b)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tile_links(threshold: float):
    """applyInPandas function: one tile to (rep, root, links), a row for each vector with links in it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, v = pdf[pdf["member"]], pdf[~pdf["member"]]
        if not len(m) or not len(v):
            return pd.DataFrame({"rep": [], "root": [], "links": []}, dtype=np.int64)
        mr, vr = m["rep"].to_numpy(), v["rep"].to_numpy()
        whole = not len(m["is"].iloc[0])        # all cells are visited, by all vectors of this length
        visits = np.zeros((len(v), int(max(m["j"].max(), max(x.max(initial=0) for x in v["js"]))) + 1), bool)
        for k, js in enumerate(v["js"]):
            visits[k, js.astype(np.int64)] = True
        visits |= whole
        close = np.stack(v["vec"].to_list()) @ np.stack(m["vec"].to_list()).T >= threshold
        close &= visits[:, m["j"].to_numpy()] & (vr[:, None] != mr[None, :])
        a, b = np.nonzero(close)
        if not len(a):
            return pd.DataFrame({"rep": [], "root": [], "links": []}, dtype=np.int64)
        # does the member's own traversal meet the visitor's cell too?  Then that tile counts its side.
        width = max(len(x) for x in m["is"])
        probes = np.full((len(m), width), -1, np.int64)
        for k, (x, y) in enumerate(zip(m["is"], m["js"], strict=True)):
            probes[k, :len(x)] = (np.asarray(x, np.int64) << 32) | np.asarray(y, np.int64)
        cell = (v["i"].to_numpy().astype(np.int64) << 32) | v["j"].to_numpy().astype(np.int64)
        mutual = np.full(len(a), whole)
        for t in range(width):
            mutual |= probes[b, t] == cell[a]
        ids, at = np.unique(np.concatenate([vr, mr]), return_inverse=True)
        va, mb = at[:len(vr)][a], at[len(vr):][b]
        vn, mn = v["n"].to_numpy(), m["n"].to_numpy()
        links = np.bincount(va, mn[b], len(ids)) + np.bincount(mb[~mutual], vn[a][~mutual], len(ids))
        root = ids[forest(va, mb, len(ids))]
        on = np.zeros(len(ids), bool)
        on[va] = on[mb] = True
        return pd.DataFrame({"rep": ids[on], "root": root[on], "links": links[on].astype(np.int64)})

    return run


def link(embeddings: DataFrame, threshold: float = 0.93, recall: float = 0.995, vec_id: str = "vec_id",
         label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; see the module's text."""
    d = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
                          F.col(vector).alias("vec"))
    ok = usable(F.col("vec_id"), F.col("label"), F.col("vec"))
    good = d.where(ok)
    classes = cut(good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
                  .select("rep", "label", "vec", "n"))
    n = classes.count()
    books = fit(classes, n)
    cells = calibrate(classes, books, n, threshold, recall)
    rows = cut(ship(classes).mapInArrow(place(books, cells), STRIPE_ROWS))
    sizes = rows.groupBy("label", "dim", "stripe").agg(
        F.ceil(F.count(F.when(F.col("member"), 1)) / TILE).cast("int").alias("tm"),
        F.ceil(F.count(F.when(~F.col("member"), 1)) / TILE).cast("int").alias("tv")).where("tm > 0 and tv > 0")
    at = F.xxhash64(F.lit("tile"), "rep")
    own = F.when(F.col("member"), F.pmod(at, F.col("tm"))).otherwise(F.pmod(at, F.col("tv"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("tv")).otherwise(F.col("tm")) - 1))
    tiled = rows.join(sizes, ["label", "dim", "stripe"]).withColumn("own", own).withColumn("other", other)
    tiled = tiled.withColumn("a", F.when(F.col("member"), F.col("own")).otherwise(F.col("other"))) \
        .withColumn("b", F.when(F.col("member"), F.col("other")).otherwise(F.col("own"))).drop("tm", "tv", "own", "other")
    # dealt by the tile: the join above leaves all tiles of a stripe in one task, which would satisfy the grouping
    tile = ["label", "dim", "stripe", "a", "b"]
    found = cut(tiled.repartition(*tile).groupBy(*tile)
                .applyInPandas(tile_links(threshold), "rep long, root long, links long"))
    comp = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    done = classes.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("label").alias("_l"), F.col("vec").alias("_v"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # classes are of usable vectors only; null labels match nothing
    out = d.withColumn("_ok", ok).join(done, F.col("_ok") & (F.col("label") == F.col("_l")) & (F.col("vec") == F.col("_v")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
