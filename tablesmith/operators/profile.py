"""Table summary, column profiles and data quality (P-1 … P-22).

Two passes serve everything:

* the **wide pass** — one ``agg`` over the table (missing counts, moments), reshaped to
  one row per column;
* the **frequency pass** — all profiled columns unpivoted to (column, value) and counted
  with ``groupBy(column, value)``; partial aggregation keeps the shuffle at one row per
  distinct value per task.  Unique counts, top values, mode and low-variance tests read
  this table.

All outputs are tidy DataFrames with one row per column (or per column and value).
Nothing is collected except schema facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import rnd, sample_kurtosis, sample_skewness
from ..functions.types import DATE_PATTERN, c, columns_of, parse_class, type_class, qcols
from ..session import checkpoint
from .common import MAX_BROADCAST_BYTES, column_stats, materialize_small, row_bytes
from .quantiles import long_values, quantile_table


def _user_cols(df: DataFrame) -> list[str]:
    return [n for n in df.columns if not n.startswith("_")]


# ---------------------------------------------------------------- P-1, P-2, PF-1/2

def column_types(df: DataFrame) -> DataFrame:
    """(column, position, dtype, type_class) — PF-1, PF-2, IO-2."""
    rows = [(f.name, i, f.dataType.simpleString(), type_class(f.dataType))
            for i, f in enumerate(df.schema.fields) if not f.name.startswith("_")]
    return df.sparkSession.createDataFrame(rows, "column string, position int, dtype string, type_class string")


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(duplicate_rows, duplicate_ratio, n_rows): rows equal on ``cols`` beyond the first
    copy (NULLs group together).  Rows are counted by a 64-bit hash first, so of a row that no other
    row's hash equals only the hash is shuffled; the others are grouped whole."""
    cols = cols or _user_cols(df)
    n = df.select(F.count(F.lit(1)).alias("n_rows"))
    # a column without a hash, or whose equal values differ in bytes, only makes the hash weaker
    hashed = [c(f.name) for f in df.schema.fields if f.name in cols
              and not any(x in f.dataType.simpleString() for x in ("map<", "variant", "collate"))]
    h = F.xxhash64(F.lit(0), *hashed)
    again = checkpoint(df.select(h.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("_h"))
    rows = df.select([c(n) for n in cols])
    few = again.agg(F.sum(row_bytes(again))).first()[0] or 0
    if few <= MAX_BROADCAST_BYTES:
        rows = rows.join(F.broadcast(again), h == F.col("_h"), "left_semi")
    g = rows.groupBy([c(n) for n in cols]).agg(F.count(F.lit(1)).alias("k"))
    return g.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("long").alias("duplicate_rows")) \
        .withColumn("n_rows", n.scalar()) \
        .withColumn("duplicate_ratio",
                    rnd(F.coalesce(F.try_divide(F.col("duplicate_rows"), F.col("n_rows")), F.lit(0.0)), 4))


def dataset_summary(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: rows, columns, duplicate rows, type lists, target and its dtype (P-1)."""
    cols = _user_cols(df)
    kinds = {k: [f.name for f in df.schema.fields if f.name in cols and type_class(f.dataType) == k]
             for k in ("numeric", "categorical", "datetime", "boolean")}
    tdt = next((f.dataType.simpleString() for f in df.schema.fields if f.name == target), None)
    dup = duplicate_rows(df, cols)
    return dup.select(
        F.col("n_rows"), F.lit(len(cols)).cast("long").alias("n_columns"), "duplicate_rows",
        F.lit(",".join(kinds["numeric"])).alias("numeric_columns"),
        F.lit(",".join(kinds["categorical"])).alias("categorical_columns"),
        F.lit(",".join(kinds["datetime"])).alias("datetime_columns"),
        F.lit(",".join(kinds["boolean"])).alias("boolean_columns"),
        F.lit(target if target in cols else None).cast("string").alias("target_column"),
        F.lit(tdt).cast("string").alias("target_dtype"))


# ---------------------------------------------------------------- wide pass

def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, missing_count, missing_ratio) for every column (P-3).  NaN counts as missing."""
    cols = cols or _user_cols(df)
    dts = {f.name: f.dataType for f in df.schema.fields}

    def miss(n):
        e = c(n).isNull()
        if isinstance(dts[n], (T.DoubleType, T.FloatType)):
            e = e | F.isnan(c(n))
        return F.sum(e.cast("long"))

    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[miss(n).alias(n) for n in cols])
    return (wide.unpivot(["__n"], qcols(cols), "column", "missing_count")
            .select("column", F.col("missing_count").cast("long").alias("missing_count"),
                    rnd(F.coalesce(F.try_divide(F.col("missing_count"), F.col("__n")), F.lit(0.0)), 4)
                    .alias("missing_ratio")))


def numeric_profile(df: DataFrame, cols: list[str] | None = None, quantiles: str = "exact",
                    target: str | None = None) -> DataFrame:
    """Moments, quartiles, zero count, sample skew/kurtosis and IQR outliers (P-5, P-6, P-7)."""
    cols = cols if cols is not None else columns_of(df, "numeric", exclude=[target] if target else None)
    if not cols:
        lv = long_values(df, cols)
        return lv.selectExpr("column", "0L AS count", *[f"value AS {x}" for x in ("mean", "std", "min", "max", "q1", "median", "q3", "iqr")],
                             "0L AS zero_count", "value AS skewness", "value AS kurtosis", "0L AS outlier_count", "value AS outlier_ratio")
    # three scans of plain columns: moments, quantiles (two), and outliers against literal fences
    mom = column_stats(df, cols, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
                                "g1": F.skewness, "g2": F.kurtosis, "zeros": lambda v: F.count_if(v == 0)})
    qs = quantile_table(df, cols, [0.25, 0.5, 0.75], quantiles).groupBy("column").pivot("p", [0.25, 0.5, 0.75]) \
        .agg(F.first("value")).toDF("column", "q1", "median", "q3")
    qs = materialize_small(qs)
    prof = mom.join(F.broadcast(qs), "column")      # a row per column
    fences = {r["column"]: (r["q1"] - 1.5 * (r["q3"] - r["q1"]), r["q3"] + 1.5 * (r["q3"] - r["q1"])) for r in qs.collect()}
    far = {n: F.count_if((c(n).cast("double") < f[0]) | ((c(n).cast("double") > f[1]) & ~F.isnan(c(n).cast("double"))))
           for n, f in fences.items()}
    out = df.agg(*[e.alias(n) for n, e in far.items()]).unpivot([], qcols(list(far)), "column", "outlier_count") \
        if far else df.sparkSession.createDataFrame([], "column string, outlier_count long")
    return (prof.join(out, "column", "left")
            .select("column", F.col("count").cast("long").alias("count"), "mean", "std", "min", "max",
                    "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
                    F.col("zeros").cast("long").alias("zero_count"),
                    sample_skewness(F.col("g1"), F.col("count")).alias("skewness"),
                    sample_kurtosis(F.col("g2"), F.col("count")).alias("kurtosis"),
                    F.coalesce("outlier_count", F.lit(0)).cast("long").alias("outlier_count"),
                    rnd(F.coalesce("outlier_count", F.lit(0)) / F.greatest(F.col("count"), F.lit(1)), 4)
                    .alias("outlier_ratio")))


def jarque_bera(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Whole-table normality statistic JB = n/6·(S² + K²/4) and the normal flag at the
    5 % level (chi² with 2 d.f.: p = exp(-JB/2)) — the aggregate form of P-8."""
    cols = cols if cols is not None else columns_of(df, "numeric")
    lv = long_values(df, cols)
    m = lv.groupBy("column").agg(F.count("value").alias("n"), F.skewness("value").alias("s"),
                                 F.kurtosis("value").alias("k"))
    jb = F.col("n") / 6.0 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4.0)
    return m.select("column", F.col("n").cast("long").alias("n"), jb.alias("jb"),
                    F.exp(-jb / 2.0).alias("p_value"), (F.exp(-jb / 2.0) > 0.05).alias("is_normal"))


def datetime_range(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, min_date, max_date) for datetime columns (P-11)."""
    cols = cols if cols is not None else columns_of(df, "datetime")
    wide = df.select([c(n).cast("timestamp_ntz").alias(n) for n in cols])
    lv = wide.unpivot([], qcols(cols), "column", "value")
    return lv.groupBy("column").agg(F.min("value").alias("min_date"), F.max("value").alias("max_date"))


# ---------------------------------------------------------------- frequency pass

def frequency_table(df: DataFrame, cols: list[str] | None = None, keep_null: bool = False) -> DataFrame:
    """(column, value string, count long): the shared frequency pass."""
    cols = cols or _user_cols(df)
    dts = {f.name: f.dataType for f in df.schema.fields}
    # NaN is missing, as in the missing profile
    wide = df.select([(F.when(~F.isnan(c(n)), c(n)) if isinstance(dts[n], (T.DoubleType, T.FloatType)) else c(n))
                      .cast("string").alias(n) for n in cols])
    lv = wide.unpivot([], qcols(cols), "column", "value")
    if not keep_null:
        lv = lv.where(F.col("value").isNotNull())
    return lv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, unique_count, top_count): distinct values and the count of the most frequent one, without
    NULL and NaN.  Values are counted in their own type, as formatting numbers costs more than counting
    them; columns without a value are left out."""
    dts = {f.name: f.dataType for f in df.schema.fields}
    kinds: dict[str, list[str]] = {}
    for n in cols:
        dt = dts[n]
        kind = ("long" if isinstance(dt, T.IntegralType) else "double" if isinstance(dt, (T.DoubleType, T.FloatType))
                else "timestamp_ntz" if isinstance(dt, T.TimestampNTZType) else "string")
        kinds.setdefault(kind, []).append(n)
    out = None
    for kind, names in sorted(kinds.items()):
        value = F.col("value")
        lv = df.select([c(n).cast(kind).alias(n) for n in names]).unpivot([], qcols(names), "column", "value")
        lv = lv.where(value.isNotNull() & ~F.isnan(value) if kind == "double" else value.isNotNull())
        part = lv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")) \
            .groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), F.max("n").alias("top_count"))
        out = part if out is None else out.unionByName(part)
    return out


def distinct_profile(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, unique_count, is_unique_per_row) without NULLs (P-4); ``approx`` uses
    HyperLogLog++ in a single wide aggregate instead of the frequency pass."""
    cols = cols or _user_cols(df)
    n = df.select(F.count(F.lit(1))).scalar()
    if approx:
        wide = df.agg(*[F.approx_count_distinct(c(n_)).alias(n_) for n_ in cols])
        u = wide.unpivot([], qcols(cols), "column", "unique_count")
    else:
        u = distinct_counts(df, cols).select("column", "unique_count")
        u = df.sparkSession.createDataFrame([(x,) for x in cols], "column string").join(u, "column", "left") \
            .fillna(0, ["unique_count"])
    return u.select("column", F.col("unique_count").cast("long").alias("unique_count"),
                    (F.col("unique_count") == n).alias("is_unique_per_row"))


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 5, freq: DataFrame | None = None) -> DataFrame:
    """(column, rank, value, count): the k most frequent values, ties by value (P-9, C-4)."""
    cols = cols if cols is not None else columns_of(df, ("categorical", "boolean"))
    f = freq if freq is not None else frequency_table(df, cols)
    # top-k per column: partial top-k would need a custom aggregate; the window here runs
    # over the frequency table (one row per distinct value), not over the rows.
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value"))
    return (f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column", F.col("rank").cast("int").alias("rank"), "value", F.col("count").cast("long").alias("count")))


def low_variance(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, unique_count, top_share, is_constant, is_near_constant, is_unique_per_row)
    — P-12, P-13.  near-constant: 1 < distinct < n and top count / all rows > 0.95."""
    cols = cols or _user_cols(df)
    n = df.select(F.count(F.lit(1))).scalar()
    f = distinct_counts(df, cols)
    base = df.sparkSession.createDataFrame([(x,) for x in cols], "column string")
    g = base.join(f, "column", "left").fillna(0, ["unique_count", "top_count"])
    share = F.coalesce(F.try_divide(F.col("top_count"), n), F.lit(0.0))
    return g.select("column", F.col("unique_count").cast("long").alias("unique_count"),
                    rnd(share, 4).alias("top_share"),
                    (F.col("unique_count") <= 1).alias("is_constant"),
                    ((F.col("unique_count") > 1) & (F.col("unique_count") < n) & (share > 0.95))
                    .alias("is_near_constant"),
                    ((F.col("unique_count") == n) & (F.col("unique_count") > 1)).alias("is_unique_per_row"))


def mixed_parse_classes(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_int, n_float, n_date, n_text, n_classes, is_mixed) over string columns (P-14)."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields
                                          if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")]
    wide = df.select([c(n).alias(n) for n in cols])
    lv = wide.unpivot([], qcols(cols), "column", "value").where(F.col("value").isNotNull())
    k = lv.select("column", parse_class(F.col("value")).alias("k"))
    g = k.groupBy("column").agg(*[F.sum((F.col("k") == x).cast("long")).alias(f"n_{x}")
                                  for x in ("int", "float", "date", "text")])
    ncls = sum((F.col(f"n_{x}") > 0).cast("int") for x in ("int", "float", "date", "text"))
    return g.select("column", *[F.col(f"n_{x}").cast("long").alias(f"n_{x}") for x in ("int", "float", "date", "text")],
                    ncls.alias("n_classes"), (ncls > 1).alias("is_mixed"))


def feature_scale(df: DataFrame, target: str | None = None, quantiles: str = "exact") -> DataFrame:
    """(column, std, kurtosis, is_wide_scale, is_heavy_tailed, is_approx_standard) — P-15.
    The median of the per-column std is taken over the tiny profile table."""
    prof = numeric_profile(df, None, quantiles, target=target)
    med = prof.select(F.percentile("std", 0.5)).scalar()
    return (prof.select("column", "std", "kurtosis",
                    (F.col("std") > 10 * med).alias("is_wide_scale"),
                    (F.abs("kurtosis") > 3).alias("is_heavy_tailed"),
                    ((F.col("std") > 0.5) & (F.col("std") < 5)).alias("is_approx_standard")))
