"""Outliers (O-1 … O-5).  Bounds are fitted on train rows; application is a projection
or a filter."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import c
from .common import param_rows
from .impute import _train
from .quantiles import quantile_table, value_at_rank


def fit_bounds(df: DataFrame, cols: list[str], method: str = "iqr", quantiles: str = "exact",
               low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(column, lower, upper): IQR fences (q1 − 1.5·iqr, q3 + 1.5·iqr) or the low/high
    quantiles, from train rows."""
    tr = _train(df)
    probs = [0.25, 0.75] if method == "iqr" else [low, high]
    qt = quantile_table(tr, cols, probs, quantiles)
    wide = qt.groupBy("column").pivot("p", probs).agg(F.first("value")).toDF("column", "a", "b")
    if method == "iqr":
        iqr = F.col("b") - F.col("a")
        return wide.select("column", (F.col("a") - 1.5 * iqr).alias("lower"), (F.col("b") + 1.5 * iqr).alias("upper"))
    return wide.select("column", F.col("a").alias("lower"), F.col("b").alias("upper"))


def _bounds(params: DataFrame) -> dict:
    return {r["column"]: (r["lower"], r["upper"]) for r in param_rows(params)}


def apply_clip(df: DataFrame, params: DataFrame) -> DataFrame:
    """least(greatest(x, lower), upper); NULL stays NULL (O-1, O-2)."""
    b = _bounds(params)
    def clip(n):
        x = c(n).cast("double")      # least and greatest skip NULL, so NULL is kept apart
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(b[n][0])), F.lit(b[n][1]))).alias(n)

    return df.select([clip(n) if n in b else c(n) for n in df.columns])


def signed_log(df: DataFrame, cols: list[str]) -> DataFrame:
    """sign(x)·ln(1 + |x|) (O-3)."""
    s = set(cols)
    return df.select([(F.signum(c(n)) * F.log1p(F.abs(c(n)))).alias(n) if n in s else c(n) for n in df.columns])


def outlier_flag(params: DataFrame):
    b = _bounds(params)
    flag = F.lit(False)
    for n, (lo, hi) in b.items():
        flag = flag | F.coalesce((c(n) < F.lit(lo)) | (c(n) > F.lit(hi)), F.lit(False))
    return flag


def remove_outlier_rows(df: DataFrame, params: DataFrame) -> DataFrame:
    """Drop rows outside the fences in any column; NULL is not an outlier (O-4)."""
    return df.where(~outlier_flag(params))


def remove_outlier_rows_capped(df: DataFrame, params: DataFrame, cap_ratio: float | None = None,
                               key: str = "_rid") -> DataFrame:
    """Drop flagged rows; with ``cap_ratio`` at most max(1, floor(n·cap)) of them, the first ones by row id (O-5),
    without it all.  The id of the last one that goes is found by narrowing, the rest is a filter."""
    flag = outlier_flag(params)
    if cap_ratio is None:
        return df.where(~flag)
    cap = max(1, math.floor(df.count() * cap_ratio))
    last = value_at_rank(df.where(flag), key, cap - 1)
    return df.where(~flag) if last is None else df.where(~flag | (c(key) > last))
