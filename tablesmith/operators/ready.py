"""Quality warnings, compact profiles, readiness and summaries (P-16, P-20, P-21, P-22,
P-24, V-1, V-2).  Each is a projection or a small aggregate over the profile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import rnd
from ..functions.types import c, columns_of, type_class
from ..session import checkpoint
from . import profile as P
from .common import materialize_small
from .relate import class_distribution, corr_matrix


def quality_warnings(df: DataFrame, target: str | None = None, static: bool = True,
                     known: dict[str, DataFrame] | None = None) -> DataFrame:
    """(type, column, value) — one row per triggered rule and column (P-16): rows < 100,
    rows < columns, missing > 0.5, constant, high-cardinality categorical (> 0.5·n
    distinct), unique per row (static), IQR outlier ratio > 0.05, non-normal (static,
    Jarque–Bera), class imbalance ≥ 3 (classification target).  ``known``: profiles of the same
    columns that the caller has already (missing, low_variance, numeric)."""
    known = known or {}
    spark = df.sparkSession
    cols = [x for x in df.columns if not x.startswith("_")]
    n = df.select(F.count(F.lit(1))).scalar()
    miss = known["missing"] if "missing" in known else P.missing_profile(df, cols)
    lowv = known["low_variance"] if "low_variance" in known else P.low_variance(df, cols)
    kinds = spark.createDataFrame([(f.name, type_class(f.dataType)) for f in df.schema.fields if f.name in cols],
                                  "column string, kind string")
    num = columns_of(df, "numeric")
    parts = [
        spark.range(1).select(F.lit("small_dataset").alias("type"), F.lit(None).cast("string").alias("column"),
                              n.cast("double").alias("value")).where(n < 100),
        spark.range(1).select(F.lit("wide_dataset").alias("type"), F.lit(None).cast("string").alias("column"),
                              n.cast("double").alias("value")).where(n < len(cols)),
        miss.where(F.col("missing_ratio") > 0.5).select(F.lit("high_missingness").alias("type"), "column",
                                                        F.col("missing_ratio").alias("value")),
        lowv.where(F.col("unique_count") <= 1).select(F.lit("constant_columns").alias("type"), "column",
                                                     F.col("unique_count").cast("double").alias("value")),
        lowv.join(kinds, "column").where((F.col("kind") == "categorical") & (F.col("unique_count") > 0.5 * n))
        .select(F.lit("high_cardinality_categoricals").alias("type"), "column", F.col("unique_count").cast("double").alias("value")),
    ]
    if static:
        parts.append(lowv.where(F.col("is_unique_per_row")).select(F.lit("unique_per_row").alias("type"), "column",
                                                                   F.col("unique_count").cast("double").alias("value")))
    if num:
        prof = known["numeric"] if "numeric" in known else P.numeric_profile(df, num)
        parts.append(prof.where(F.col("outlier_ratio") > 0.05).select(F.lit("high_outlier_ratio").alias("type"), "column",
                                                                      F.col("outlier_ratio").alias("value")))
        if static:
            jb = P.jarque_bera(df, num)
            parts.append(jb.where(~F.col("is_normal")).select(F.lit("non_normal").alias("type"), "column",
                                                               rnd(F.col("p_value"), 6).alias("value")))
    if target is not None and not isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType)):
        d = class_distribution(df, target)
        k = d.agg(F.count(F.lit(1)).alias("k"), rnd(F.max("count") / F.min("count"), 2).alias("imb"))
        parts.append(k.where((F.col("k") <= 20) & (F.col("imb") >= 3))
                     .select(F.lit("class_imbalance").alias("type"), F.lit(target).alias("column"), F.col("imb").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(df: DataFrame, target: str | None = None, cols: list[str] | None = None, top: int = 5) -> DataFrame:
    """P-22: the stage report as (section, column, metric, value) rows: missing and distinct values, numbers, low
    variance, most frequent values, date ranges (seconds since 1970), correlations, classes and warnings."""
    cols = cols or [x for x in df.columns if not x.startswith("_")]
    d = checkpoint(df.select(*[c(x) for x in cols]))        # every section reads it
    numbers = columns_of(d, "numeric")
    # a row a column each; the warnings read them too
    known = {"missing": materialize_small(P.missing_profile(d)), "low_variance": materialize_small(P.low_variance(d))}
    if numbers:
        known["numeric"] = materialize_small(P.numeric_profile(d, numbers))

    def long(section, table, metrics):
        return table.select("column", *[F.col(m).cast("double").alias(m) for m in metrics]) \
            .unpivot(["column"], metrics, "metric", "value").select(F.lit(section).alias("section"), "column", "metric", "value")

    def pairs(section, table, column, metric, value):
        return table.select(F.lit(section).alias("section"), column, metric, value.cast("double").alias("value"))

    parts = [long("missing", known["missing"], ["missing_count", "missing_ratio"]),
             long("low_variance", known["low_variance"], ["unique_count", "top_share", "is_constant", "is_near_constant", "is_unique_per_row"])]
    if numbers:
        parts.append(long("numeric", known["numeric"], [
            "count", "mean", "std", "min", "max", "q1", "median", "q3", "iqr", "zero_count", "skewness", "kurtosis",
            "outlier_count", "outlier_ratio"]))
        parts.append(pairs("correlation", corr_matrix(d, numbers), F.col("a").alias("column"), F.col("b").alias("metric"), F.col("corr")))
    if texts := columns_of(d, ("categorical", "boolean")):
        parts.append(pairs("top_values", P.top_values(d, texts, top), F.col("column"), F.col("value").alias("metric"), F.col("count")))
    if dates := columns_of(d, "datetime"):
        r = P.datetime_range(d, dates)
        parts += [pairs("datetime", r, F.col("column"), F.lit(m).alias("metric"), F.unix_seconds(F.col(m).cast("timestamp")))
                  for m in ("min_date", "max_date")]
    if target is not None:
        parts.append(pairs("classes", class_distribution(d, target), F.lit(target).alias("column"), F.col("class").alias("metric"), F.col("count")))
    parts.append(pairs("warnings", quality_warnings(d, target, known=known), F.col("column"), F.col("type").alias("metric"), F.col("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value").isNotNull())


def compact_profile(df: DataFrame, target: str) -> DataFrame:
    """P-20: rows, columns, missing % over all cells, target distinct count."""
    cols = [x for x in df.columns if not x.startswith("_")]
    miss = sum((c(x).isNull().cast("long") for x in cols), F.lit(0))
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.lit(len(cols)).cast("long").alias("n_columns"),
                  (F.sum(miss) / (F.count(F.lit(1)) * float(len(cols))) * 100).alias("missing_pct"),
                  F.count_distinct(c(target)).cast("long").alias("target_distinct"))


def profile_digest(df: DataFrame, target: str | None = None, quantiles: str = "exact") -> DataFrame:
    """P-21: base stats per numeric column; outlier ratio only if > 0, skewness only if
    |skew| > 1 (always for the target)."""
    prof = P.numeric_profile(df, columns_of(df, "numeric"), quantiles)
    is_t = F.col("column") == F.lit(target) if target else F.lit(False)
    return prof.select("column", "mean", "std", "min", "max",
                       F.when(F.col("outlier_ratio") > 0, F.col("outlier_ratio")).alias("outlier_ratio"),
                       F.when((F.abs("skewness") > 1) | is_t, F.col("skewness")).alias("skewness"))


def readiness(df: DataFrame, target: str) -> DataFrame:
    """V-1: one row per feature: numeric type, missing count (all splits), infinite count,
    and the blocker it raises (NULL when the column is ready)."""
    cols = [x for x in df.columns if not x.startswith("_") and x != target]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([("", False, 0, 0, "no_features")],
                                     "column string, is_numeric boolean, missing long, infinite long, blocker string")
    isnum = {x: isinstance(df.schema[x].dataType, T.NumericType) for x in cols}
    aggs = []
    for x in cols:
        aggs.append(F.sum(c(x).isNull().cast("long")).alias(f"m|{x}"))
        inf = (F.abs(c(x).cast("double")) == F.lit(float("inf"))) if isnum[x] else F.lit(False)
        aggs.append(F.sum(inf.cast("long")).alias(f"i|{x}"))
    wide = df.agg(*aggs)
    stack = F.array(*[F.struct(F.lit(x).alias("column"), F.lit(isnum[x]).alias("is_numeric"),
                               F.col(f"`m|{x}`").alias("missing"), F.col(f"`i|{x}`").alias("infinite")) for x in cols])
    out = wide.select(F.explode(stack).alias("s")).select("s.*")
    blocker = (F.when(~F.col("is_numeric"), "non_numeric").when(F.col("missing") > 0, "missing_values")
               .when(F.col("infinite") > 0, "infinite_values"))
    return out.select("column", "is_numeric", F.col("missing").cast("long"), F.col("infinite").cast("long"),
                      blocker.alias("blocker"))


def prep_summary(df: DataFrame, target: str, n_raw: int | None = None) -> DataFrame:
    """V-2: rows, features, train/test rows, rows removed versus the raw table."""
    cols = [x for x in df.columns if not x.startswith("_") and x != target]
    split = F.col("_split") if "_split" in df.columns else F.lit("train")
    g = df.agg(F.count(F.lit(1)).cast("long").alias("rows"),
               F.sum((split == "train").cast("long")).alias("train_rows"),
               F.sum((split == "test").cast("long")).alias("test_rows"))
    return g.select("rows", F.lit(len(cols)).cast("long").alias("features"),
                    F.col("train_rows").cast("long"), F.col("test_rows").cast("long"),
                    (F.lit(n_raw) - F.col("rows")).cast("long").alias("rows_removed") if n_raw is not None
                    else F.lit(0).cast("long").alias("rows_removed"))


def report_tables(df: DataFrame, target: str) -> dict[str, DataFrame]:
    """What a stored report says of a table, as small tables: summary, numeric, missing, distinct, target."""
    cols = [x for x in df.columns if not x.startswith("_")]
    d = checkpoint(df.select(*[c(x) for x in cols]))        # every table reads it
    classes = d.where(c(target).isNotNull()).groupBy(c(target)).agg(F.count(F.lit(1)).alias("k"))
    ratio = F.max("k") / F.min("k")
    return {"summary": P.duplicate_rows(d, cols).select("n_rows", F.lit(len(cols)).cast("long").alias("n_columns"), "duplicate_rows"),
            "numeric": P.numeric_profile(d).select("column", "mean", "std", "min", "max"),
            "missing": P.missing_profile(d).select("column", "missing_count"),
            "distinct": P.distinct_profile(d).select("column", "is_unique_per_row"),
            "target": classes.agg(F.when(F.count(F.lit(1)) <= 20, "classification").otherwise("regression").alias("task_type"),
                                  F.when((F.count(F.lit(1)) > 1) & (ratio >= 3), ratio).alias("imbalance_ratio"))}


def report_audit(stored: dict[str, DataFrame], df: DataFrame, target: str) -> DataFrame:
    """P-24: a stored report (``report_tables``) against the table itself, as (section, item, value).

    ``invariant``: 1 where rows and columns agree; ``fidelity``: relative errors in percent of mean, standard
    deviation and range of each number column; ``coverage``: of the problems that the table has (missing
    cells, duplicate rows, unique columns), 1 where the report has them too; ``agreement``: 1 where task and
    imbalance agree; ``trust``: the four as percentages, and their mean."""
    was = {k: t.collect() for k, t in stored.items()}               # a row a column at most
    now = {k: t.collect() for k, t in report_tables(df, target).items()}
    rows = []

    def add(section, items):
        rows.extend((section, k, float(v)) for k, v in items.items())
        return sum(map(float, items.values())) / len(items) * 100 if items else 100.0

    a, b = was["summary"][0], now["summary"][0]
    parts = {"invariant": add("invariant", {k: a[k] == b[k] for k in ("n_rows", "n_columns")})}
    old = {r["column"]: r for r in was["numeric"]}

    def error(x, y):
        return abs(x - y) / (abs(y) + 1e-9) * 100

    errors = {}
    for r in now["numeric"]:
        o = old.get(r["column"])
        if o is None or r["mean"] is None or o["mean"] is None:
            continue
        errors |= {f"{r['column']}.mean": error(o["mean"], r["mean"]), f"{r['column']}.std": error(o["std"] or 0.0, r["std"] or 0.0),
                   f"{r['column']}.range": max(error(o["min"], r["min"]), error(o["max"], r["max"]))}
    add("fidelity", errors)
    parts["fidelity"] = max(0.0, 100 - (sum(errors.values()) / len(errors) if errors else 0.0))

    def problems(t):
        return {"missing_cells": any(r["missing_count"] for r in t["missing"]), "duplicate_rows": t["summary"][0]["duplicate_rows"] > 0,
                "unique_columns": any(r["is_unique_per_row"] for r in t["distinct"])}

    there, said = problems(now), problems(was)
    parts["coverage"] = add("coverage", {k: said[k] for k, v in there.items() if v})
    a, b = was["target"][0], now["target"][0]
    parts["agreement"] = add("agreement", {"task": a["task_type"] == b["task_type"],
                                           "imbalance": (a["imbalance_ratio"] is None) == (b["imbalance_ratio"] is None)})
    rows += [("trust", k, v) for k, v in parts.items()] + [("trust", "overall", sum(parts.values()) / 4)]
    return df.sparkSession.createDataFrame(rows, "section string, item string, value double")
