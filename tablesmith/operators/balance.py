"""Class balancing (B-1 … B-7).

Class counts are a small aggregate (one row per class).  Re-sampling draws are hash
functions of (class, draw number), and the rows they pick are found by joining on
(class, exact hash rank) — no class is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..functions.types import c
from .sample import rank_by_hash, take_by_hash


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, n); rows without a class belong to none."""
    return df.where(c(target).isNotNull()).groupBy(c(target)).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, target: str, name: str = "class_weight") -> DataFrame:
    """w_c = max count / max(count_c, 1), train rows only when ``_split`` exists (B-1).
    The per-class table is tiny, so it is broadcast into the row table."""
    src = df.where(F.col("_split") == "train") if "_split" in df.columns else df
    cc = class_counts(src, target)
    mx = cc.select(F.max("n")).scalar()
    w = cc.select(c(target), (mx / F.greatest(F.col("n"), F.lit(1))).alias(name))
    return df.join(F.broadcast(w), target, "left").withColumn(name, F.coalesce(F.col(name), F.lit(1.0)))


def undersample(df: DataFrame, target: str, seed=42, key: str = "_rid") -> DataFrame:
    """Keep min-class-count rows of every class, the smallest hashes (B-3).  Rows with a
    missing target belong to no class and are not kept."""
    df = df.where(c(target).isNotNull())
    cc = class_counts(df, target)
    mn = cc.select(F.min("n")).scalar()
    quota = cc.select(c(target), mn.alias("take"))
    return take_by_hash(df, quota, key, seed, [target]).where("_take").drop("_take")


def undersample_guarded(df: DataFrame, target: str, min_keep: float = 0.6, min_ratio: float = 1.5,
                        seed=42, key: str = "_rid") -> DataFrame:
    """Static rule (B-4): nothing when max/min < 1.5; skipped when the result would keep
    less than 60 % of the rows that have a class.  Two numbers from the class table decide."""
    cc = class_counts(df, target)
    s = cc.agg(F.max("n").alias("mx"), F.min("n").alias("mn"), F.count(F.lit(1)).alias("k"),
               F.sum("n").alias("tot")).first()
    if s["mn"] is None or s["mx"] / max(s["mn"], 1) < min_ratio or s["mn"] * s["k"] < min_keep * s["tot"]:
        return df
    return undersample(df, target, seed, key)


DRAW_CHUNK = 1_000_000


def draw_table(need: DataFrame, group: str, count_col: str = "need") -> DataFrame:
    """(group, _j) for j = 1 … need per group, generated in parallel: the small per-class
    table is exploded into chunks of ``DRAW_CHUNK`` draws first, the chunks are spread over
    tasks, and each task expands its own chunk — no single task makes all draws."""
    chunks = need.select(c(group), F.col(count_col).cast("long").alias("_need"),
                         F.explode(F.sequence(F.lit(0).cast("long"),
                                              F.ceil(F.col(count_col) / DRAW_CHUNK).cast("long") - 1)).alias("_chunk"))
    n_chunks = max(1, chunks.count())
    return (chunks.repartition(n_chunks)
            .select(c(group), F.explode(F.sequence(F.col("_chunk") * DRAW_CHUNK + 1,
                                                   F.least((F.col("_chunk") + 1) * DRAW_CHUNK, F.col("_need")))).alias("_j")))


def oversample(df: DataFrame, target: str, seed=42, key: str = "_rid", keep_originals: bool = True) -> DataFrame:
    """Random over-sampling to the largest class (B-2).  keep_originals: originals plus
    (max − n_c) draws with replacement; else the whole class is re-drawn (max draws).
    Draw j of class c picks the row of exact hash rank hash(c, j) mod n_c.  Rows without a
    class are kept once among the originals and never drawn."""
    cc = class_counts(df, target)
    mx = cc.select(F.max("n")).scalar()
    need = cc.select(c(target), "n", (mx - F.col("n") if keep_originals else mx).alias("need"))
    draws = (draw_table(need.where(F.col("need") > 0), target).join(need.select(c(target), "n"), target)
             .withColumn("_rank", F.pmod(hash_int(F.concat_ws(":", c(target).cast("string"), F.col("_j").cast("string")),
                                                   seed), F.col("n")))
             .select(c(target), "_j", "_rank"))
    ranked = rank_by_hash(df, key, seed, [target])
    picked = ranked.join(draws, [target, "_rank"]).drop("_rank").withColumnRenamed("_j", "_copy")
    base = ranked.drop("_rank").withColumn("_copy", F.lit(0).cast("long"))
    # a drawn row keeps its _rid; (_rid, _copy) identifies every output row
    return (base.unionByName(picked) if keep_originals else picked)


def balance_report(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """(stage, class, count) before and after balancing (B-7)."""
    b = class_counts(before, target).select(F.lit("before").alias("stage"), c(target).cast("string").alias("class"),
                                            F.col("n").cast("long").alias("count"))
    a = class_counts(after, target).select(F.lit("after").alias("stage"), c(target).cast("string").alias("class"),
                                           F.col("n").cast("long").alias("count"))
    return b.unionByName(a)
