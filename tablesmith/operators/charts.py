"""Data behind the charts (C-1 … C-8); drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..functions.types import c, columns_of
from .profile import missing_profile, top_values
from .quantiles import long_values, quantiles_of_long
from .sample import few_or_written, low_hashes


def chart_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C-1: columns with gaps, most missing first (ties by name)."""
    return missing_profile(df, cols).where(F.col("missing_count") > 0).orderBy(F.desc("missing_count"), "column")


def chart_histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 20) -> DataFrame:
    """C-2: (column, bin, lower, upper, count) with equal-width bins over [min, max], last
    bin closed, empty bins present; a constant column spans [v − 0.5, v + 0.5]."""
    cols = cols if cols is not None else columns_of(df, "numeric")
    lv = long_values(df, cols)
    mm = lv.groupBy("column").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    rng = mm.select("column", F.when(F.col("mx") > F.col("mn"), F.col("mn")).otherwise(F.col("mn") - 0.5).alias("lo"),
                    F.when(F.col("mx") > F.col("mn"), F.col("mx")).otherwise(F.col("mx") + 0.5).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    counted = (lv.join(F.broadcast(rng), "column")          # one row per column
               .withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
               .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (grid.join(counted, ["column", "bin"], "left")
            .select("column", "bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def chart_sample(df: DataFrame, cols: list[str] | None = None, n: int = 50, seed=42, key: str = "_rid") -> DataFrame:
    """C-3: n non-null values per numeric column, picked by hash rank among the rows of low hashes."""
    cols = cols if cols is not None else columns_of(df, "numeric")
    lv = low_hashes(df.select(key, *[c(x).cast("double").alias(x) for x in cols]), cols, n, key, seed)
    w = Window.partitionBy("column").orderBy("_h", key)
    return lv.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("column", key, "value")


def chart_categories(df: DataFrame, cols: list[str] | None = None, k: int = 10, max_columns: int | None = None,
                     max_levels: int = 20) -> DataFrame:
    """C-4: top-k bars of the categorical columns of at most ``max_levels`` levels (a bar chart of more
    is not readable), of the first ``max_columns`` of them where a caller sets that."""
    cols = cols if cols is not None else columns_of(df, "categorical")
    nd = df.agg(*[F.count_distinct(c(x)).alias(x) for x in cols]).first()
    low = [x for x in cols if nd[x] <= max_levels][:max_columns]
    return top_values(df, low, k)


def chart_count_hue(df: DataFrame, a: str, b: str, k: int = 15) -> DataFrame:
    """C-5: counts of (a, b) for the k most frequent values of a (semi-join)."""
    top = df.groupBy(c(a)).count().withColumn("r", F.row_number().over(Window.orderBy(F.desc("count"), c(a)))) \
        .where(F.col("r") <= k).select(a)
    return df.join(top, a, "left_semi").groupBy(c(a).cast("string").alias("a"), c(b).cast("string").alias("b")) \
        .agg(F.count(F.lit(1)).cast("long").alias("count"))


def chart_box(df: DataFrame, col: str, group: str | None = None, quantiles: str = "exact") -> DataFrame:
    """C-6: q1, median, q3 and whiskers (extreme values inside 1.5·IQR fences) per group."""
    g = c(group).cast("string") if group else F.lit("all")
    lv = df.select(g.alias("column"), c(col).cast("double").alias("value")).where(F.col("value").isNotNull() &
                                                                                F.col("column").isNotNull())
    q = quantiles_of_long(lv, [0.25, 0.5, 0.75], quantiles, few_keys=group is None)
    # read by the fences and by the result: a row a group
    q = few_or_written(q.groupBy("column").pivot("p", [0.25, 0.5, 0.75]) \
        .agg(F.first("value")).toDF("column", "q1", "median", "q3"))
    f = q.withColumn("lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
        .withColumn("hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    fences = f.select("column", "lo", "hi")
    w = lv.join(few_or_written(fences), "column") \
        .groupBy("column").agg(F.min(F.when(F.col("value") >= F.col("lo"), F.col("value"))).alias("whisker_low"),
                               F.max(F.when(F.col("value") <= F.col("hi"), F.col("value"))).alias("whisker_high"))
    return q.join(w, "column").withColumnRenamed("column", "group")


def chart_scatter(df: DataFrame, x: str, y: str, hue: str | None = None, n: int = 1000, seed=42,
                  key: str = "_rid") -> DataFrame:
    """C-7: a bounded hash sample of (x, y[, hue]) — distributed top-k by hash."""
    cols = [key, c(x).alias("x"), c(y).alias("y")] + ([c(hue).cast("string").alias("hue")] if hue else [])
    return df.where(c(x).isNotNull() & c(y).isNotNull()).select(*cols, hash_int(key, seed).alias("_h")) \
        .orderBy("_h", key).limit(n).drop("_h")


def chart_target(df: DataFrame, target: str, task: str = "classification") -> DataFrame:
    """C-8: class counts, or the histogram of a numeric target."""
    if task == "regression":
        return chart_histogram(df, [target])
    return df.groupBy(c(target).cast("string").alias("class")).agg(F.count(F.lit(1)).cast("long").alias("count"))
