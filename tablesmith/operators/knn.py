"""Nearest neighbours and the operators built on them (J-5, N-8, B-5, B-6): exact and complete.

Every probe row gets its min(k, rows there are) nearest base rows by Euclidean distance, ties by
id.  Rows are projected on a few orthonormal axes (the main directions of a bounded sample, so
only speed depends on it) and laid on a grid as wide as a radius: base rows within the radius lie
in a neighbouring cell, so the candidates of a round hold all of them.  A probe that has its k
within the radius is done; the others go on with twice the radius.  The first radius comes from a
few probes and is halved until a row meets ``MOST`` candidates on average, so dense regions are
settled at small radii and no all-pairs product is formed.

That holds as long as the axes hold the whole vector.  Vectors of more than ``AXES`` numbers are
searched by tiles instead (``search_tiles``): rows near one pivot are packed into blocks, a block
of probes gets a bound for its k-th distance from the nearest block of base rows, and meets only
blocks that can hold something nearer.  A tile is one matrix product; what its rounding leaves open is computed
exactly.  Without clusters all tiles are computed, with two blocks in a task's memory.

Equal vectors are searched once for all of them, and of the base rows with one vector only the
smallest ids that can be among the k nearest are kept (a group limit before the shuffle).  Rows
whose vector is missing or not finite have no neighbours and are none.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_int, uniform
from ..functions.types import c
from ..session import checkpoint
from .sample import rank_by_hash, take_by_hash

PROBES = 64             # rows that give the first radius
AXES_SAMPLE = 512       # rows that give the axes
AXES = 3
MOST = 256              # candidates of a row on average, in the first round
WIDE = 1 + 1e-9         # a cell is a trifle wider than the radius, as projections are rounded
NO_CELL = -(1 << 62)    # cell of a missing coordinate
BLOCK_BYTES = 16 << 20  # vectors of a block
BLOCKS = 16             # blocks that a smaller table is cut into
MOST_PIVOTS = 1024
TILE_CELLS = 1 << 22    # distances that a task holds at once
SLACK = 1e-9            # of the vectors' length, far more than a rounding error


def to_vectors(df: DataFrame, cols: list[str] | None = None, array_col: str | None = None,
               out: str = "features") -> DataFrame:
    if array_col:
        return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def distance(a: Column, b: Column) -> Column:
    """Euclidean over the coordinates that both arrays have, scaled up to all of them; null where they share none."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    total = F.aggregate(sq, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    shared = F.size(F.filter(sq, lambda v: v.isNotNull()))
    return F.sqrt(F.when(shared == F.size(a), total).otherwise(F.try_divide(total * F.size(a), shared)))


def axes_of(rows: DataFrame, x: str, key: str, seed: int = 42) -> list[list[float]]:
    """Main directions of a hash-chosen sample of complete vectors."""
    got = rows.orderBy(hash_int(key, f"{seed}:axes"), key).limit(AXES_SAMPLE).select(x).collect()
    m = np.array([r[0] for r in got], np.float64)
    if not len(m):
        return []
    return np.linalg.svd(m - m.mean(axis=0), full_matrices=False)[2][:AXES].tolist()


def project(x: Column, axes: list[list[float]]) -> Column:
    return F.array(*[F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in a]), lambda p, q: p * q), F.lit(0.0),
                                 lambda s, v: s + v) for a in axes])


def _cells(df: DataFrame, r: float, m: int, spread: tuple = (0,)) -> DataFrame:
    """``df`` with the cells c0, c1, … of its coordinates y; ``spread``: the cells around them, None for the
    cell of missing coordinates."""
    at = [F.coalesce(F.floor(F.col("y")[i] / (r * WIDE)), F.lit(NO_CELL)) for i in range(m)]
    if spread == (0,):
        return df.withColumns({f"c{i}": a for i, a in enumerate(at)})
    cells = F.array(*[F.struct(*[(F.lit(NO_CELL) if s is None else a + s).cast("long").alias(f"c{i}")
                                 for i, (a, s) in enumerate(zip(at, steps, strict=True))])
                      for steps in product(spread, repeat=m)])
    return df.withColumn("_c", F.explode(cells)).select("*", "_c.*").drop("_c")


def candidates(probes: DataFrame, base: DataFrame, r: float, m: int, spread: tuple = (-1, 0, 1)) -> DataFrame:
    """Pairs a, b of a probe and a base row that can lie within ``r`` by every coordinate of y."""
    a, b = _cells(probes, r, m, spread).alias("a"), _cells(base, r, m).alias("b")
    met = reduce(and_, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ["g", *(f"c{i}" for i in range(m))]])
    near = reduce(and_, [F.coalesce(F.abs(F.col("a.y")[i] - F.col("b.y")[i]) <= r * WIDE, F.lit(True)) for i in range(m)])
    return a.join(b, met & near)


def search(probes: DataFrame, base: DataFrame, need: int, m: int, gaps: bool = False) -> DataFrame:
    """(pid, bid, dist): for each of ``probes`` (pid, g, y, x) the min(need, rows of its g) nearest of ``base``
    (bid, g, y, x).  y: ``m`` coordinates that differ by no more than the distance does; with ``gaps`` base
    rows may lack coordinates.  Both tables are read once a round: give written ones."""
    spread = (-1, 0, 1, None) if gaps else (-1, 0, 1)
    keys = ["g", *(f"c{i}" for i in range(m))]
    sizes = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    todo = checkpoint(probes.join(sizes, "g").withColumn("want", F.least(F.col("n"), F.lit(need))).drop("n"))
    rows, done = todo.count(), None
    r = first_radius(todo, base, need, rows, m, keys, spread) if rows else 1.0
    by = Window.partitionBy("pid")
    while rows:
        found = candidates(todo, base, r, m, spread) \
            .select("a.pid", "a.want", "b.bid", distance(F.col("a.x"), F.col("b.x")).alias("dist"))
        top = found.where(F.col("dist") <= r).withColumn("rank", F.row_number().over(by.orderBy("dist", "bid"))) \
            .where(F.col("rank") <= need)
        top = checkpoint(top.withColumn("full", F.count(F.lit(1)).over(by) >= F.col("want")))
        full = top.where("full")
        done = full if done is None else done.unionByName(full)
        todo = checkpoint(todo.join(full.select("pid").distinct(), "pid", "left_anti"))
        rows = todo.count()
        r *= 2
    if done is None:
        return probes.join(base.select("bid", "g"), "g").select("pid", "bid", F.lit(0.0).alias("dist")).limit(0)
    return done.select("pid", "bid", "dist")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pack(rows: DataFrame, name: str, pivots: np.ndarray, most: int) -> DataFrame:
    """Written blocks of about ``most`` of ``rows`` (name, g, x) of one g that have the same nearest pivot: block, g, n,
    center, radius, reach (length of the longest vector), and their ids, ascending, and vectors."""
    dim, kind = pivots.shape[1], rows.schema[name].dataType.simpleString()

    def nearest_pivot(batches):
        for b in batches:
            x = matrix(b.column(2), dim)
            with np.errstate(all="ignore"):
                far = (pivots ** 2).sum(axis=1) - 2 * (x @ pivots.T)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far.argmin(axis=1))], [name, "g", "x", "cell"])

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by(name).combine_chunks()
        x = matrix(t["x"].chunk(0), dim)
        with np.errstate(all="ignore"):
            center = x.mean(axis=0)
            radius, reach = (np.sqrt((v ** 2).sum(axis=1).max()) for v in (x - center, x))
        ids = t[name].chunk(0)
        return pa.table({"g": t["g"][:1], "n": [len(x)], "center": [center.tolist()], "radius": [radius], "reach": [reach],
                         "ids": pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids), "xs": [x.tobytes()]})

    celled = checkpoint(rows.select(name, "g", "x").mapInArrow(nearest_pivot, f"{name} {kind}, g string, x array<double>, cell long"))
    parts = celled.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("parts"))
    made = celled.join(parts, ["g", "cell"]).withColumn("part", F.pmod(F.xxhash64(name), "parts")) \
        .select(name, "g", "x", "cell", "part").groupBy("g", "cell", "part").applyInArrow(
            block, f"g string, n long, center array<double>, radius double, reach double, ids array<{kind}>, xs binary")
    return checkpoint(made.withColumn("block", F.monotonically_increasing_id()))


def nearest(p: np.ndarray, b: np.ndarray, need: int, bound: np.ndarray, center: np.ndarray, radius: float):
    """(probe, base row, dist): the ``need`` nearest rows of ``b`` for each of ``p``, none beyond its ``bound``; ties by
    row.  ``b`` lies within ``radius`` of ``center``."""
    dim, out = p.shape[1], []
    with np.errstate(all="ignore"):
        p2, b2 = (p ** 2).sum(axis=1), (b ** 2).sum(axis=1)
        reach = np.sqrt(p2) + np.sqrt(b2.max())
        away = np.sqrt(((p - center) ** 2).sum(axis=1)) - radius > bound + SLACK * reach
        live = np.flatnonzero(~away)
        step = max(1, TILE_CELLS // len(b))
        for rows in (live[i:i + step] for i in range(0, len(live), step)):
            d2 = p2[rows, None] + b2 - 2 * (p[rows] @ b.T)
            # a product of sums is off by no more than this, so that no row within the bound is missed
            off = 8 * (dim + 8) * np.finfo(float).eps * reach[rows] ** 2
            limit = bound[rows] ** 2 + off
            many = np.flatnonzero((d2 <= limit[:, None]).sum(axis=1) > need)
            if len(many):
                kth = np.partition(d2[many], need - 1, axis=1)[:, need - 1]
                limit[many] = np.fmin(limit[many], kth + 2 * off[many])
            i, j = np.nonzero(~(d2 > limit[:, None]))
            i, exact = rows[i], np.zeros(len(i))
            for k in range(dim):        # in the order of ``distance``, so both give the same number
                exact += (p[i, k] - b[j, k]) * (p[i, k] - b[j, k])
            exact = np.sqrt(exact)
            i, j, exact = (v[exact <= bound[i]] for v in (i, j, exact))
            order = np.lexsort((j, exact, i))
            i, j, exact = i[order], j[order], exact[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            out.append((i[rank < need], j[rank < need], exact[rank < need]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, (int, int, float)[k]) for k in range(3))


def search_tiles(probes: DataFrame, base: DataFrame, need: int, dim: int, seed: int = 42) -> DataFrame:
    """(pid, bid, dist) as ``search``, for vectors of ``dim`` numbers, none missing: by tiles of a block of ``probes``
    (pid, g, x) and a block of ``base`` (bid, g, x).  Give written tables."""
    kind = base.schema["bid"].dataType.simpleString()
    rows = [t.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0 for t in (probes, base)]
    most = [max(512, min(BLOCK_BYTES // (8 * dim), 1 << 15, -(-n // BLOCKS))) for n in rows]
    some = base.orderBy(hash_int("bid", f"{seed}:pivots"), "bid").limit(min(MOST_PIVOTS, -(-rows[1] // most[1]) or 1))
    pivots = np.array([r[0] for r in some.select("x").collect()], np.float64).reshape(-1, dim)      # speed alone depends on it
    if not len(pivots):
        return probes.join(base.select("bid", "g"), "g").select("pid", "bid", F.lit(0.0).alias("dist")).limit(0)
    p, b = pack(probes, "pid", pivots, most[0]), pack(base, "bid", pivots, most[1])
    short = ["g", "block", "n", "center", "radius", "reach"]
    sides = [t.select("g", *[F.col(x).alias(f"{k}_{x}") for x in short[1:]]) for t, k in ((p, "p"), (b, "b"))]
    met = sides[0].join(sides[1], "g").withColumn("between", distance(F.col("p_center"), F.col("b_center")))
    p, b = (t.select(*[F.col(x).alias(f"{k}_{x}") for x in ("block", "ids", "xs", "center", "radius")]) for t, k in ((p, "p"), (b, "b")))

    def vectors(row: bytes) -> np.ndarray:
        return np.frombuffer(row, np.float64).reshape(-1, dim)

    def tile(t, i, bound):
        return nearest(vectors(t["p_xs"][i].as_py()), vectors(t["b_xs"][i].as_py()), need, bound,
                       np.array(t["b_center"][i].as_py()), t["b_radius"][i].as_py())

    def bounds(batches):
        for t in batches:
            for i in range(t.num_rows):
                n = len(t["p_ids"][i])
                at, _, dist = tile(t, i, np.full(n, np.inf))
                far = np.full(n, np.inf)
                far[at[need - 1::need]] = dist[need - 1::need]      # the block holds ``need`` rows at least
                yield pa.RecordBatch.from_arrays([t["p_block"][i:i + 1], pa.array([far.tobytes()]), pa.array([far.max()])],
                                                 ["p_block", "far", "most"])

    def found(batches):
        for t in batches:
            for i in range(t.num_rows):
                n = len(t["p_ids"][i])
                far = t["far"][i].as_py()
                at, which, dist = tile(t, i, np.full(n, np.inf) if far is None else np.frombuffer(far, np.float64))
                yield pa.RecordBatch.from_arrays([t["p_ids"][i].values.take(pa.array(at)), t["b_ids"][i].values.take(pa.array(which)),
                                                  pa.array(dist)], ["pid", "bid", "dist"])

    def tiles(pairs):
        pairs = checkpoint(pairs)
        return p.join(pairs, "p_block").join(b.join(pairs.select("p_block", "b_block"), "b_block"), ["p_block", "b_block"])

    first = met.where(F.col("b_n") >= need).groupBy("p_block").agg(F.min_by("b_block", F.struct("between", "b_block")).alias("b_block"))
    far = checkpoint(tiles(first).drop("b_ids").mapInArrow(bounds, "p_block long, far binary, most double"))
    away = F.col("between") - F.col("p_radius") - F.col("b_radius") - SLACK * (F.col("p_reach") + F.col("b_reach"))
    pairs = met.join(far.select("p_block", "most"), "p_block", "left").where(~F.coalesce(away > F.col("most"), F.lit(False)))
    out = tiles(pairs.select("p_block", "b_block")).join(far.select("p_block", "far"), "p_block", "left") \
        .mapInArrow(found, f"pid long, bid {kind}, dist double")
    by = Window.partitionBy("pid").orderBy("dist", "bid")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= need).select("pid", "bid", "dist")


def first_radius(probes: DataFrame, base: DataFrame, need: int, rows: int, m: int, keys: list, spread: tuple) -> float:
    """A distance at which the denser rows have ``need`` neighbours, halved until rows meet few candidates."""
    asked = probes.orderBy(hash_int("pid", "probe"), "pid").limit(PROBES).select("pid", "g", "x").collect()
    some = base.sparkSession.createDataFrame(asked, probes.select("pid", "g", "x").schema).alias("a")  # PROBES rows
    d = F.broadcast(some).join(base.alias("b"), F.col("a.g") == F.col("b.g")) \
        .select("a.pid", "b.bid", distance(F.col("a.x"), F.col("b.x")).alias("d")).where("d IS NOT NULL")
    w = Window.partitionBy("pid").orderBy("d", "bid")
    kth = sorted(x["d"] for x in d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= need)
                 .groupBy("pid").agg(F.max("d").alias("d")).collect() if x["d"] > 0)
    r = kth[len(kth) // 4] if kth else 1.0
    for _ in range(60):
        held = _cells(base, r, m).groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
        asked = _cells(probes.select("g", "y"), r, m, spread).groupBy(*keys).agg(F.count(F.lit(1)).alias("q"))
        pairs = held.join(asked, keys).agg(F.sum(F.col("k").cast("double") * F.col("q"))).first()[0] or 0.0
        if pairs <= MOST * len(spread) * rows:
            break
        r /= 2
    return r


def knn_join(probe: DataFrame, base: DataFrame, k: int = 5, key: str = "id", vec: str = "features",
             same_group: str | None = None, exclude_self: bool = True, seed: int = 42) -> DataFrame:
    """(id, nb_id, dist, rank) — the min(k, rows) nearest base rows of every probe row, ties by id; with
    ``same_group`` only rows of the same group pair, and rows without a group have no neighbours."""
    need = k + 1 if exclude_self else k
    x = vector_to_array(vec)
    g = F.col(same_group).cast("string") if same_group else F.lit("")

    def rows(df, name):
        fine = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        return df.select(F.col(key).alias(name), g.alias("g"), x.alias("x")).where(F.col("g").isNotNull() & fine)

    same = Window.partitionBy("g", "x").orderBy("bid")
    b = rows(base, "bid").withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= need).drop("_copy")
    b = checkpoint(b)
    asked = rows(probe, "id")
    classes = checkpoint(asked.select("g", "x").distinct().withColumn("pid", F.monotonically_increasing_id()))
    dims = sorted(r[0] for t in (b, classes) for r in t.select(F.size("x")).distinct().collect())
    if dims and dims[0] == dims[-1] > AXES:
        near = checkpoint(search_tiles(classes, b, need, dims[0], seed))
    else:
        axes = axes_of(b, "x", "bid", seed)
        b, classes = (t.withColumn("y", project(F.col("x"), axes) if axes else F.array(F.lit(0.0))) for t in (b, classes))
        near = search(classes, b, need, max(1, len(axes)))
    out = asked.join(classes.select("g", "x", "pid"), ["g", "x"]).select("id", "pid").join(near, "pid")
    if exclude_self:
        out = out.where(F.col("id") != F.col("bid"))
    w = Window.partitionBy("id").orderBy("dist", "bid")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("id", F.col("bid").alias("nb_id"), "dist", "rank")


def impute_knn(df: DataFrame, cols: list[str], k: int = 5, key: str = "_rid") -> DataFrame:
    """N-8: gaps filled with the mean of the k nearest train rows that have the value.

    Distance over the coordinates present in both rows, scaled by p/|present| (nan-Euclidean).  Rows
    with the same gaps are searched together, on a grid over coordinates that they have; donors
    that lack one of those stand in a cell of their own, which every probe looks up.  Only where no train
    row has the value and shares a coordinate, the train mean fills the gap."""
    fit = df.where(F.col("_split") == "train") if "_split" in df.columns else df
    value = {x: F.when(~F.isnan(c(x).cast("double")), c(x).cast("double")) for x in cols}
    means = fit.agg(*[F.avg(value[x]).alias(x) for x in cols]).first().asDict()
    spread = fit.agg(*[F.stddev_samp(value[x]).alias(x) for x in cols]).first().asDict()
    pattern = F.concat(*[F.when(value[x].isNull(), "0").otherwise("1") for x in cols])
    rows = df.select(F.col(key).alias("pid"), F.array(*[value[x] for x in cols]).alias("x"), pattern.alias("p")) \
        .where(F.col("p").contains("0"))
    rows = checkpoint(rows)
    # equal rows are searched once, and of equal donors only the k of the smallest ids can be among the nearest
    asked = checkpoint(rows.select("p", "x").distinct().withColumn("pid", F.monotonically_increasing_id()))
    given = checkpoint(fit.select(F.col(key).alias("bid"), F.array(*[value[x] for x in cols]).alias("x")))
    same = Window.partitionBy("x").orderBy("bid")
    donors = checkpoint(given.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k).drop("_copy"))
    by = Window.partitionBy("pid").orderBy("dist", "bid")
    fills = None
    for row in asked.select("p").distinct().collect():      # the ways in which rows have gaps
        have = [i for i, b in enumerate(row["p"]) if b == "1"]
        if not have:
            continue
        grid = sorted(have, key=lambda i: -(spread[cols[i]] or 0.0))[:AXES]     # widest coordinates first
        y = F.array(*[F.col("x")[i] for i in grid])
        mine = asked.where(F.col("p") == row["p"]).withColumn("y", y).withColumn("g", F.lit("")).drop("p")
        shared = reduce(lambda a, b: a | b, [F.col("x")[i].isNotNull() for i in have])
        for i, x in enumerate(cols):
            if i in have:
                continue
            near = search(mine, donors.where(F.col("x")[i].isNotNull() & shared).withColumn("y", y).withColumn("g", F.lit("")),
                          k, len(grid), gaps=True)
            near = checkpoint(asked.join(near, "pid").drop("pid"))
            near = rows.join(near, ["p", "x"]).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            fill = near.join(given.select("bid", F.col("x")[i].alias("v")), "bid") \
                .groupBy("pid").agg(F.avg("v").alias("fill")).select("pid", F.lit(x).alias("col"), "fill")
            fills = fill if fills is None else fills.unionByName(fill)
    out = df
    if fills is not None:
        wide = fills.groupBy(F.col("pid").alias("_pid")).pivot("col", cols).agg(F.first("fill")) \
            .withColumnsRenamed({x: f"_fill_{i}" for i, x in enumerate(cols)})
        out = df.join(wide, F.col(key) == F.col("_pid"), "left")
    filled = {x: F.coalesce(value[x], F.col(f"_fill_{i}") if fills is not None else F.lit(None), F.lit(means[x])).alias(x)
              for i, x in enumerate(cols)}
    return out.select([filled.get(x, c(x)) for x in df.columns])


def smote(df: DataFrame, target: str, vec: str = "features", key: str = "_rid", k: int = 5,
          seed: int = 42) -> DataFrame:
    """B-5: synthetic rows up to the largest class: draw j of class c picks base row
    hash(c,j,1) mod n_c (by exact hash rank), neighbour hash(c,j,2) mod k_found among its
    same-class neighbours, gap u(c,j,3); x = base + gap·(nb − base).  Output: (target,
    features array, synthetic flag) for originals and synthetic rows."""
    cc = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    mx = cc.select(F.max("n")).scalar()
    need = cc.select(target, "n", (mx - F.col("n")).alias("need")).where(F.col("need") > 0)
    from .balance import draw_table
    draws = (draw_table(need, target).join(need.select(target, "n"), target)
             .withColumn("_tag", F.concat_ws(":", F.col(target).cast("string"), F.col("_j").cast("string")))
             .withColumn("_rank", F.pmod(hash_int("_tag", f"{seed}:1"), F.col("n")))
             .withColumn("_pick", hash_int("_tag", f"{seed}:2"))
             .withColumn("_gap", uniform("_tag", f"{seed}:3")))
    ranked = rank_by_hash(df, key, seed, [target])
    base = ranked.join(draws, [target, "_rank"]).select(target, "_pick", "_gap", F.col(key).alias("id"))
    return _between(df, base, target, vec, key, k)


def _picked(df: DataFrame, base: DataFrame, target: str, vec: str, key: str, k: int) -> DataFrame:
    """``base`` (id, _pick, _gap, …) with ``nb_id``, the picked one of the row's same-class neighbours; null where
    it has none."""
    nb = knn_join(df.withColumnRenamed(key, "id"), df.withColumnRenamed(key, "id"), k, "id", vec,
                  same_group=target)
    kf = nb.groupBy("id").agg(F.count(F.lit(1)).alias("kf"))
    b2 = base.join(kf, "id", "left").withColumn("nb_rank", F.when(F.col("kf") > 0, F.pmod("_pick", "kf") + 1))
    return b2.join(nb.select("id", F.col("nb_id"), F.col("rank").alias("nb_rank")), ["id", "nb_rank"], "left")


def _point() -> Column:
    """``_gap`` of the way from _x to its neighbour _y, or _x itself."""
    return F.when(F.col("_y").isNull(), F.col("_x")).otherwise(F.zip_with("_x", "_y", lambda a, b: a + F.col("_gap") * (b - a)))


def _between(df: DataFrame, base: DataFrame, target: str, vec: str, key: str, k: int) -> DataFrame:
    """The rows of ``df`` and one synthetic row for each of ``base`` (class, id, _pick, _gap): a point at ``_gap``
    of the way to the picked one of the row's same-class neighbours; the only row of a class is copied."""
    arr = df.select(F.col(key).alias("id"), vector_to_array(vec).alias("_x"))
    synth = (_picked(df, base, target, vec, key, k).join(arr, "id")
             .join(arr.select(F.col("id").alias("nb_id"), F.col("_x").alias("_y")), "nb_id", "left")
             .select(target, _point().alias("features"), F.lit(True).alias("synthetic")))
    orig = df.select(target, vector_to_array(vec).alias("features"), F.lit(False).alias("synthetic"))
    return orig.unionByName(synth)


def _allocated_draws(need: DataFrame, seed) -> DataFrame:
    """``n_i`` draws (_pick, _gap) of each row of ``need`` (id, n_i, …)."""
    tag = F.concat_ws(":", F.col("id").cast("string"), F.col("_j").cast("string"))
    return need.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), "n_i"))) \
        .withColumns({"_pick": hash_int(tag, f"{seed}:2"), "_gap": uniform(tag, f"{seed}:3")}).drop("_j")


def adasyn(df: DataFrame, target: str, vec: str = "features", key: str = "_rid", k: int = 5,
           seed: int = 42) -> DataFrame:
    """B-6: as ``smote``, with ``adasyn_allocation`` synthetic rows for each row: more where other classes are near."""
    known = df.where(F.col(target).isNotNull())
    need = adasyn_allocation(known, target, vec, key, k).where("n_i > 0")
    base = _allocated_draws(need, seed).select(F.col("class").alias(target), "id", "_pick", "_gap")
    return _between(df, base, target, vec, key, k)


def adasyn_samples(df: DataFrame, target: str, vec: str = "features", key: str = "_rid", k: int = 5,
                   seed: int = 42) -> DataFrame:
    """B-6 from the allocation to the rows made: (id, class, r, n_i, synthetic, features) of every row that has a class,
    and of the ``n_i`` synthetic rows made from it, which have its id, r and n_i."""
    known = df.where(F.col(target).isNotNull())
    rows = checkpoint(adasyn_allocation(known, target, vec, key, k, vectors=True))
    draws = _allocated_draws(rows.where("n_i > 0"), seed)
    # rows that share an id are one neighbour, so that a draw makes one row
    y = known.groupBy(F.col(key).alias("nb_id")).agg(F.min(vector_to_array(vec)).alias("_y"))
    made = _picked(known, draws, target, vec, key, k).join(y, "nb_id", "left") \
        .select("id", "class", "r", "n_i", F.lit(True).alias("synthetic"), _point().alias("features"))
    return rows.select("id", "class", "r", "n_i", F.lit(False).alias("synthetic"), F.col("_x").alias("features")).unionByName(made)


def adasyn_allocation(df: DataFrame, target: str, vec: str = "features", key: str = "_rid", k: int = 5,
                      vectors: bool = False) -> DataFrame:
    """B-6: per minority row, the share r_i of other-class rows among its k neighbours,
    weights r_i / Σ r (uniform when Σ r = 0), and n_i by largest remainder of
    (max − n_c)·weight within the class.  Returns (id, class, r, n_i), with ``vectors`` the row's numbers _x too."""
    nb = knn_join(df.withColumnRenamed(key, "id"), df.withColumnRenamed(key, "id"), k, "id", vec)
    lab = df.select(F.col(key).alias("id"), F.col(target).alias("cls"))
    j = nb.join(lab, "id").join(lab.select(F.col("id").alias("nb_id"), F.col("cls").alias("nb_cls")), "nb_id")
    r = j.groupBy("id", "cls").agg(F.avg((F.col("cls") != F.col("nb_cls")).cast("double")).alias("r"))
    cc = df.groupBy(F.col(target).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    mx = cc.select(F.max("n")).scalar()
    held = df.select(F.col(key).alias("id"), F.col(target).alias("cls"), vector_to_array(vec).alias("_x")) if vectors else lab
    rows = held.join(r.drop("cls"), "id", "left").fillna(0.0, ["r"])
    # per-class totals by aggregate (one row per class, broadcast back), no class-wide window
    tot = rows.groupBy("cls").agg(F.sum("r").alias("tot"), F.count(F.lit(1)).alias("cnt")).join(cc, "cls")
    a = rows.join(F.broadcast(tot), "cls")
    wgt = F.when(F.col("tot") > 0, F.col("r") / F.col("tot")).otherwise(1.0 / F.col("cnt"))
    a = a.withColumn("_ex", (F.lit(mx) - F.col("n")) * wgt).withColumn("_base", F.floor("_ex")) \
        .withColumn("_rem", F.col("_ex") - F.col("_base"))
    left = a.groupBy("cls").agg(((F.lit(mx) - F.first("n")) - F.sum("_base")).alias("take"))
    # largest remainders first: order value (1 − rem)·(2^32 − 1), exact take per class
    order = F.floor((F.lit(1.0) - F.col("_rem")) * F.lit(4294967295.0))
    t = take_by_hash(a, left, key="id", group=["cls"], order_value=order)
    return t.select("id", F.col("cls").alias("class"), "r",
                    (F.col("_base") + F.col("_take").cast("long")).cast("long").alias("n_i"), *(["_x"] if vectors else []))
