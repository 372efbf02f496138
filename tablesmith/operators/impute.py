"""Missing values (N-1 … N-7, N-9).

``fit_impute`` aggregates the fill values over the training rows in one pass and returns
a params DataFrame (column, method, num_value, str_value, ts_value); ``apply_impute``
inlines them as literals in one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import c, qcols
from .common import param_rows, column_stats
from .quantiles import quantile_table

PARAM_SCHEMA = "column string, method string, num_value double, str_value string, ts_value timestamp_ntz"
EPOCH = "1970-01-01 00:00:00"


def _train(df: DataFrame, split_col: str = "_split") -> DataFrame:
    return df.where(F.col(split_col) == "train") if split_col in df.columns else df


def fit_impute(df: DataFrame, methods: dict[str, str], quantiles: str = "exact") -> DataFrame:
    """methods: column → mean | median | mode | constant | indicator | datetime.
    Statistics come from train rows only (when ``_split`` is present)."""
    tr = _train(df)
    spark = df.sparkSession
    dts = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    num_cols = [k for k, m in methods.items() if m in ("mean", "median", "indicator") and isinstance(dts[k], T.NumericType)]
    if num_cols:
        base = spark.createDataFrame([(k, methods[k]) for k in num_cols], "column string, method string")
        of_mean = [k for k in num_cols if methods[k] == "mean"]
        of_median = [k for k in num_cols if methods[k] != "mean"]
        none = spark.createDataFrame([], "column string, x double")
        means = column_stats(tr, of_mean, {"mean": F.avg}) if of_mean else none.withColumnRenamed("x", "mean")
        meds = quantile_table(tr, of_median, [0.5], quantiles) \
            .select("column", F.col("value").alias("median")) if of_median else none.withColumnRenamed("x", "median")
        stat = base.join(means, "column", "left").join(meds, "column", "left")
        # all-missing column → 0
        parts.append(stat.select("column", "method",
                                 F.coalesce(F.when(F.col("method") == "mean", F.col("mean")).otherwise(F.col("median")),
                                            F.lit(0.0)).alias("num_value"),
                                 F.lit(None).cast("string").alias("str_value"),
                                 F.lit(None).cast("timestamp_ntz").alias("ts_value")))
    mode_cols = [k for k, m in methods.items()
                 if m == "mode" and not isinstance(dts[k], (T.TimestampType, T.TimestampNTZType, T.DateType))]
    if mode_cols:
        lv = tr.select([c(k).cast("string").alias(k) for k in mode_cols]).unpivot([], qcols(mode_cols), "column", "value") \
            .where(F.col("value").isNotNull())
        freq = lv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
        top = freq.withColumn("r", F.row_number().over(w)).where("r = 1")
        base = spark.createDataFrame([(k, methods[k]) for k in mode_cols], "column string, method string")
        parts.append(base.join(top, "column", "left").select(
            "column", "method",
            F.lit(None).cast("double").alias("num_value"),
            F.coalesce(F.col("value"), F.lit("missing")).alias("str_value"),
            F.lit(None).cast("timestamp_ntz").alias("ts_value")))
    ts_cols = [k for k, m in methods.items() if isinstance(dts[k], (T.TimestampType, T.TimestampNTZType, T.DateType))
               and m not in ("none", "drop_rows")]
    if ts_cols:
        lv = tr.select([c(k).cast("timestamp_ntz").alias(k) for k in ts_cols]).unpivot([], qcols(ts_cols), "column", "value") \
            .where(F.col("value").isNotNull())
        freq = lv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
        top = freq.withColumn("r", F.row_number().over(w)).where("r = 1")
        base = spark.createDataFrame([(k, "datetime") for k in ts_cols], "column string, method string")
        parts.append(base.join(top, "column", "left").select(
            "column", "method", F.lit(None).cast("double").alias("num_value"), F.lit(None).cast("string").alias("str_value"),
            F.coalesce(F.col("value"), F.lit(EPOCH).cast("timestamp_ntz")).alias("ts_value")))
    # a text gap with an indicator reads "missing", as a constant does
    timed = (T.TimestampType, T.TimestampNTZType, T.DateType)
    const = [k for k, m in methods.items() if m == "constant"
             or (m == "indicator" and not isinstance(dts[k], (T.NumericType, *timed)))]
    if const:
        parts.append(spark.createDataFrame(
            [(k, methods[k], 0.0 if isinstance(dts[k], T.NumericType) else None,
              None if isinstance(dts[k], T.NumericType) else "missing", None) for k in const], PARAM_SCHEMA))
    if not parts:
        return spark.createDataFrame([], PARAM_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_impute(df: DataFrame, params: DataFrame, indicator_suffix: str = "__missing") -> DataFrame:
    """Fill gaps with the fitted values; ``indicator`` also adds ``{col}__missing``."""
    rows = {r["column"]: r for r in param_rows(params)}
    dts = {f.name: f.dataType for f in df.schema.fields}
    sel = []
    for n in df.columns:
        r = rows.get(n)
        if r is None:
            sel.append(c(n))
            continue
        if r["method"] == "indicator":
            sel.append(c(n).isNull().cast("int").alias(n + indicator_suffix))
        if r["ts_value"] is not None:
            fill = F.lit(r["ts_value"]).cast(dts[n])
        elif r["num_value"] is not None and isinstance(dts[n], T.NumericType):
            fill = F.lit(r["num_value"])
            if not isinstance(dts[n], (T.DoubleType, T.FloatType)):
                # integral columns: filled value may be fractional, promote to double
                sel.append(F.coalesce(c(n).cast("double"), fill).alias(n))
                continue
        else:
            fill = F.lit(r["str_value"])
        col = c(n)
        if isinstance(dts[n], (T.DoubleType, T.FloatType)):
            col = F.when(~F.isnan(col), col)
        sel.append(F.coalesce(col, fill.cast(dts[n]) if r["ts_value"] is None else fill).alias(n))
    return df.select(sel)


def drop_rows_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows where any of ``cols`` is missing (PF-5, N-7), per split alike."""
    return df.dropna(subset=cols)


def ml_imputer(cols: list[str], strategy: str = "median", suffix: str = "_imp"):
    """MLlib stage for search grids (N-9): ``Imputer`` with mean / median / mode."""
    from pyspark.ml.feature import Imputer
    return Imputer(inputCols=cols, outputCols=[x + suffix for x in cols], strategy=strategy)
