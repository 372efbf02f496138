"""De-duplication, splitting and sampling (D-1 … D-9).

Randomness is a hash of the row key (see ``functions.hashing``), so every result is
independent of partitioning and reproducible in SQL.

Exact "take n rows per group" never ranks a whole group in one task: rows are cut into
2^16 hash buckets, a small (group, bucket) count table gives the boundary bucket per
group, and only the rows of the boundary bucket are ranked to find the exact threshold.
The final assignment is a map-only filter against a tiny broadcast threshold table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_int, uniform
from ..functions.types import c, qcols
from ..session import checkpoint
from .common import few_or_written, join_groups
from .quantiles import value_at_rank

# 32-bit hash >> 16 → 2^16 buckets: the (group, bucket) count table stays ≤ 65,536 rows per
# group, and the only rows ever ranked together (one boundary bucket per group) are about
# n / 65,536 — 15 M rows at 10^12 rows, a single sort within one task.
BUCKET_SHIFT = 16
HEAD_ROWS = 50      # rows read for each first value that is wanted


def with_row_id(df: DataFrame, key: str | list[str] | None = None, name: str = "_rid") -> DataFrame:
    """Add a stable row id.  From a natural key when given (recommended: it survives
    recomputation), else ``monotonically_increasing_id`` (stable only for a fixed input
    layout; checkpoint the result before relying on it)."""
    if name in df.columns:
        return df
    if key is None:
        return df.withColumn(name, F.monotonically_increasing_id())
    keys = [key] if isinstance(key, str) else key
    if len(keys) == 1:
        return df.withColumn(name, c(keys[0]).cast("long"))
    return df.withColumn(name, F.xxhash64(*[c(k) for k in keys]))


def dedupe_exact(df: DataFrame, cols: list[str] | None = None, key: str = "_rid") -> DataFrame:
    """Drop exact duplicate rows (D-1); with a row id the smallest id of each copy group is
    kept, so the survivor is deterministic."""
    cols = cols or [n for n in df.columns if not n.startswith("_")]
    if key not in df.columns:
        return df.dropDuplicates(cols)
    # the copy of the smallest id is taken whole: one shuffle, and copies that share an id count as copies
    rest = [n for n in df.columns if n != key and n not in cols]
    if not rest:        # a plain number is aggregated by hash, a struct by sorting; an id that is NULL is the smallest
        first = F.when(F.count(c(key)) == F.count(F.lit(1)), F.min(c(key)))
        return df.groupBy([c(n) for n in cols]).agg(first.alias("_first")) \
            .select([F.col("_first").alias(n) if n == key else c(n) for n in df.columns])
    kept = df.groupBy([c(n) for n in cols]).agg(
        F.min(F.struct(c(key).alias("k"), *[c(n).alias(f"r{i}") for i, n in enumerate(rest)])).alias("_first"))
    return kept.select([F.col("_first.k").alias(n) if n == key else
                        F.col(f"_first.r{rest.index(n)}").alias(n) if n in rest else c(n) for n in df.columns])


def _buckets(df: DataFrame, key: str, seed, order_value=None) -> DataFrame:
    """``_h``: the 32-bit ordering value (the key hash, or a caller's value in [0, 2^32));
    ``_b``: its top 16 bits."""
    h = hash_int(key, seed) if order_value is None else order_value.cast("long")
    return df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", BUCKET_SHIFT))


def bucket_counts(df: DataFrame, key: str = "_rid", seed=42, group: list[str] | None = None) -> DataFrame:
    """(group…, _b, _n): rows per (group, hash bucket) — one pass, partially aggregated.
    Group sizes and the total are sums over this small table, so no extra scan is needed."""
    g = list(group or [])
    return _buckets(df, key, seed).groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_n"))


def take_by_hash(df: DataFrame, quota: DataFrame, key: str = "_rid", seed=42,
                 group: list[str] | None = None, flag: str = "_take", counts: DataFrame | None = None,
                 order_value=None) -> DataFrame:
    """Mark (``flag``=True) exactly ``quota.take`` rows per group — the ones with the
    smallest (hash(key, seed), key), or smallest (``order_value``, key) when given.
    ``quota`` has the group columns and ``take``; ``counts`` may pass in an already
    computed ``bucket_counts`` table."""
    g = list(group or [])
    d = _buckets(df, key, seed, order_value)
    bc = counts if counts is not None else d.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_n"))
    if not g:
        d = d.withColumn("_g", F.lit(0))
        bc = bc.withColumn("_g", F.lit(0))
        quota = quota.withColumn("_g", F.lit(0))
        g = ["_g"]
    w = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    bc = bc.withColumn("_cum", F.sum("_n").over(w))
    q = quota.select(*g, F.col("take").cast("long").alias("take"))
    edge = (join_groups(bc, q, g)
            .where((F.col("_cum") - F.col("_n") < F.col("take")) & (F.col("_cum") >= F.col("take")))
            .select(*g, F.col("_b").alias("_bb"), (F.col("take") - F.col("_cum") + F.col("_n")).alias("_need")))
    # rows of the boundary bucket only (≈ n / 2^16 per group) are ranked
    edge_rows = join_groups(d, edge, g).where(F.col("_b") == F.col("_bb"))
    wr = Window.partitionBy(*g).orderBy("_h", key)
    thr = (edge_rows.withColumn("_r", F.row_number().over(wr)).where(F.col("_r") == F.col("_need"))
           .select(*g, "_bb", F.col("_h").alias("_th"), F.col(key).alias("_tk")))
    out = join_groups(d, few_or_written(thr), g, "left")        # a filter of each row against its group's threshold
    take = (F.col("_b") < F.col("_bb")) | ((F.col("_b") == F.col("_bb")) & (
        (F.col("_h") < F.col("_th")) | ((F.col("_h") == F.col("_th")) & (F.col(key) <= F.col("_tk")))))
    drop = ["_h", "_b", "_bb", "_th", "_tk"] + (["_g"] if g == ["_g"] else [])
    return out.withColumn(flag, F.coalesce(take, F.lit(False))).drop(*drop)


def first_values(df: DataFrame, cols: list[str], k: int, key: str = "_rid", distinct: bool = False) -> DataFrame:
    """(column, r, value): each column's first ``k`` values in key order that are not NULL, as texts; with ``distinct`` the
    first ``k`` different ones, in the order of the smallest key that has them.  The table's first rows hold them for most
    columns (a top-k of rows, nothing is sorted); a column with fewer values there is ranked whole."""
    wide = df.select(key, *[c(x).alias(x) for x in cols])
    head = checkpoint(wide.orderBy(key).limit(HEAD_ROWS * k))
    held = {x: F.size(F.collect_set(c(x).cast("string"))) if distinct else F.count(c(x)) for x in cols}     # of the first rows only
    row = head.agg(F.count(F.lit(1)).alias("_all"), *[n.alias(x) for x, n in held.items()]).first()
    short = [x for x in cols if row[x] < k] if row["_all"] == HEAD_ROWS * k else []

    def ranked(d, names):
        lv = d.select(key, *[c(x).cast("string").alias(x) for x in names]).unpivot([key], qcols(names), "column", "value")
        lv, w = lv.where(F.col("value").isNotNull()), Window.partitionBy("column").orderBy(key)
        if distinct:        # a key that is NULL is the smallest
            first = F.when(F.count(c(key)) == F.count(F.lit(1)), F.min(c(key)))
            lv, w = lv.groupBy("column", "value").agg(first.alias(key)), w.orderBy(key, "value")
        return lv.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("column", "r", "value")

    parts = [ranked(d, names) for d, names in ((head, [x for x in cols if x not in short]), (wide, short)) if names]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def low_hashes(df: DataFrame, cols: list[str], n: int, key: str = "_rid", seed=42) -> DataFrame:
    """(column, key, value, _h): of each column's values that are not NULL those of the lowest key hashes, at least
    ``n`` of them or all.  Hashes are spread evenly over [0, 2^32), so a bound slightly above n / count keeps
    enough rows in one filter; a column that got too few is filtered again under a bound four times as high."""
    wide = df.select(key, *[c(x).alias(x) for x in cols])
    total = wide.agg(*[F.count(c(x)).alias(x) for x in cols]).first()
    share = {x: min(1.0, (n + 8 * math.sqrt(n)) / max(total[x], 1)) for x in cols}
    h, parts, todo = F.col("_h"), [], list(cols)
    while todo:
        top = {x: math.ceil(share[x] * 2 ** 32) for x in todo}
        d = wide.select(key, hash_int(key, seed).alias("_h"), *[c(x) for x in todo])
        d = d.where(h.isNull() | (h < max(top.values())))
        d = checkpoint(d.select(key, "_h", *[F.when(h.isNull() | (h < top[x]), c(x)).alias(x) for x in todo]))
        got = d.agg(*[F.count(c(x)).alias(x) for x in todo]).first()
        done = [x for x in todo if got[x] >= min(n, total[x])]
        if done:
            lv = d.select(key, "_h", *[c(x) for x in done]).unpivot([key, "_h"], qcols(done), "column", "value")
            parts.append(lv.where(F.col("value").isNotNull()).select("column", key, "value", "_h"))
        todo = [x for x in todo if x not in done]
        share.update({x: min(1.0, 4 * share[x]) for x in todo})
    return reduce(DataFrame.unionByName, parts)


def rank_by_hash(df: DataFrame, key: str = "_rid", seed=42, group: list[str] | None = None,
                 name: str = "_rank") -> DataFrame:
    """0-based exact rank within ``group`` by (hash(key, seed), key).  The window is
    partitioned by (group, hash bucket), so no task holds a whole group; bucket offsets
    come from a small cumulative count table."""
    g = list(group or [])
    d = _buckets(df, key, seed)
    bc = d.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0) if g else \
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    off = bc.withColumn("_off", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    wr = Window.partitionBy(*g, "_b").orderBy("_h", key)
    return (join_groups(d, off, g + ["_b"])
            .withColumn(name, (F.col("_off") + F.row_number().over(wr) - 1).cast("long"))
            .drop("_h", "_b", "_off"))


def _largest_remainder(counts: DataFrame, total: Column, group: list[str]) -> DataFrame:
    """Allocate ``total`` over groups proportionally to ``n`` by largest remainder
    (ties by group value).  ``counts`` is the small per-class table (one row per class),
    so the un-partitioned windows below run over a handful of rows."""
    n_all = F.sum("n").over(Window.partitionBy())
    a = counts.withColumn("_exact", total * F.col("n") / n_all)
    a = a.withColumn("_base", F.floor("_exact")).withColumn("_rem", F.col("_exact") - F.col("_base"))
    left = total - F.sum("_base").over(Window.partitionBy())
    wr = Window.orderBy(F.col("_rem").desc(), *[F.col(x) for x in group])
    return (a.withColumn("_extra", (F.row_number().over(wr) <= left).cast("long"))
            .select(*group, "n", (F.col("_base") + F.col("_extra")).cast("long").alias("take")))


def split_random(df: DataFrame, test_size: float = 0.2, seed=42, key: str = "_rid",
                 exact: bool = True) -> DataFrame:
    """Add ``_split`` ('train'/'test').  exact: test = the ceil(n·p) rows with the smallest
    hash (D-2); approximate: hash < p (map-only, no count)."""
    if not exact:
        return df.withColumn("_split", F.when(uniform(key, seed) < test_size, "test").otherwise("train"))
    bc = bucket_counts(df, key, seed).cache()             # ≤ 65,536 rows, reused 2×
    quota = bc.agg(F.ceil(F.sum("_n") * F.lit(test_size)).alias("take"))
    out = take_by_hash(df, quota, key, seed, counts=bc)
    return out.withColumn("_split", F.when(F.col("_take"), "test").otherwise("train")).drop("_take")


def split_stratified(df: DataFrame, target: str, test_size: float = 0.2, seed=42,
                     key: str = "_rid") -> DataFrame:
    """Stratified split (D-3): ceil(n·p) test rows allocated over classes by largest
    remainder, then the smallest-hash rows of each class."""
    # one pass: (class, hash bucket) counts; class sizes and n are sums over it
    bc = bucket_counts(df, key, seed, [target]).cache()   # ≤ 65,536 rows per class, reused 3×
    counts = bc.groupBy(target).agg(F.sum("_n").alias("n"))
    n = counts.select(F.sum("n")).scalar()
    quota = _largest_remainder(counts, F.ceil(n * F.lit(test_size)), [target])
    out = take_by_hash(df, quota.select(target, "take"), key, seed, [target], counts=bc)
    return out.withColumn("_split", F.when(F.col("_take"), "test").otherwise("train")).drop("_take")


def drop_rare_classes(df: DataFrame, target: str, min_count: int = 2) -> DataFrame:
    """Keep rows whose class has at least ``min_count`` rows (PF-8, semi-join)."""
    valid = df.groupBy(target).count().where(F.col("count") >= min_count).select(target)
    return df.join(valid, target, "left_semi")


def split_ordered(df: DataFrame, test_size: float = 0.2, key: str = "_rid") -> DataFrame:
    """Split without shuffling rows (D-4): the last ceil(n·p) rows in key order are test.
    The cut key is found by narrowing the range that holds it; the split itself is a filter."""
    n = df.count()
    cut = value_at_rank(df, key, n - math.ceil(n * test_size) - 1)      # the last key in train; None if there is none
    return df.withColumn("_split", F.when(c(key) > cut, "test").otherwise("train") if cut is not None else F.lit("test"))


def kfold_assign(df: DataFrame, k: int = 5, target: str | None = None, seed=42, key: str = "_rid") -> DataFrame:
    """Fold id 0..k-1 (D-5): rank within class by hash, modulo k (sizes differ by ≤1)."""
    g = [target] if target else []
    r = rank_by_hash(df, key, seed, g)
    return r.withColumn("_fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def sample_guard(df: DataFrame, max_rows: int = 1_000_000, max_features: int = 500, seed=42,
                 key: str = "_rid") -> DataFrame:
    """Down-sample very large training tables (D-6): if rows > max_rows or features >
    max_features keep rows with u < min(0.05, 500000/n)."""
    n = df.select(F.count(F.lit(1))).scalar()
    nfeat = len([x for x in df.columns if not x.startswith("_")])
    frac = F.least(F.lit(0.05), F.lit(500000.0) / n)
    big = (n > max_rows) | F.lit(nfeat > max_features)
    return df.where(~big | (uniform(key, seed) < frac))


def shuffle_order(df: DataFrame, seed=42, key: str = "_rid") -> DataFrame:
    """Seeded full shuffle (D-8): a deterministic order column (ties by key); sorting is
    left to the consumer so no global sort happens unless asked for."""
    return df.withColumn("_order", hash_int(key, seed))


def head_n(df: DataFrame, n: int = 5, key: str = "_rid") -> DataFrame:
    """First n rows by the row id (D-9): a distributed top-k (TakeOrderedAndProject)."""
    return df.orderBy(key).limit(n)
