"""Scaling, normalising, reduction and selection (K-1 … K-9).

Scaler parameters are one row per column, fitted on train rows in a single aggregate and
inlined as literals, so ``apply_*`` is one projection (whole-stage codegen).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import norm_ppf_np
from ..functions.types import c, qcols
from .common import param_rows, column_stats
from .impute import _train
from .quantiles import even_quantiles, long_values, quantile_table


def fit_scaler(df: DataFrame, cols: list[str], method: str = "standard", quantiles: str = "exact") -> DataFrame:
    """(column, center, scale) so that x' = (x − center) / scale.
    standard: mean, population std (0 → 1); minmax: min, max−min (0 → 1, constant → 0);
    robust: median, q3−q1 (0 → 1)."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, center double, scale double")
    if method == "standard":
        st = column_stats(_train(df), cols, {"center": F.avg, "s": F.stddev_pop})
    elif method == "minmax":
        st = column_stats(_train(df), cols, {"center": F.min, "s": lambda v: F.max(v) - F.min(v)})
    elif method == "robust":
        q = quantile_table(_train(df), cols, [0.25, 0.5, 0.75], quantiles)
        st = (q.groupBy("column").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value")).toDF("column", "a", "m", "b")
              .select("column", F.col("m").alias("center"), (F.col("b") - F.col("a")).alias("s")))
    else:
        raise ValueError(method)
    return st.select("column", F.coalesce("center", F.lit(0.0)).alias("center"),
                     F.when((F.col("s") == 0) | F.col("s").isNull(), F.lit(1.0)).otherwise(F.col("s")).alias("scale"))


def apply_scaler(df: DataFrame, params: DataFrame) -> DataFrame:
    p = {r["column"]: (r["center"], r["scale"]) for r in param_rows(params)}
    return df.select([((c(n).cast("double") - F.lit(p[n][0])) / F.lit(p[n][1])).alias(n) if n in p else c(n)
                      for n in df.columns])


# ------------------------------------------------------------------ K-4 quantile → normal

def fit_quantile(df: DataFrame, cols: list[str], n_quantiles: int = 1000) -> DataFrame:
    """(column, knots array<double>): m = min(n_quantiles, n) knots at j/(m−1)."""
    lv = long_values(_train(df), cols)
    sizes = {r["column"]: max(2, min(n_quantiles, r["n"]))         # one row per column
             for r in lv.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return even_quantiles(lv, sizes).groupBy("column") \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda s: s["value"]).alias("knots"))


def _quantile_normal(x: pd.Series, knots) -> pd.Series:
    k = np.asarray(knots, dtype="float64")
    refs = np.linspace(0, 1, len(k))
    v = x.to_numpy(dtype="float64")
    out = np.full(v.shape, np.nan)
    ok = ~np.isnan(v)
    # two-sided interpolation averages ties from both directions
    u = 0.5 * (np.interp(v[ok], k, refs) - np.interp(-v[ok], -k[::-1], -refs[::-1]))
    u = np.clip(u, 1e-7, 1 - 1e-7)
    out[ok] = norm_ppf_np(u)
    return pd.Series(out)


def apply_quantile(df: DataFrame, params: DataFrame) -> DataFrame:
    """Arrow-batched pandas UDF per column; the knots (≤ 1000 per column) are literals."""
    kn = {r["column"]: list(r["knots"]) for r in param_rows(params)}
    sel = []
    for n in df.columns:
        if n not in kn:
            sel.append(c(n))
            continue
        sel.append(_quantile_udf(kn[n])(c(n).cast("double")).alias(n))
    return df.select(sel)


def _quantile_udf(knots):
    @F.pandas_udf(T.DoubleType())
    def qn(x: pd.Series) -> pd.Series:
        return _quantile_normal(x, knots)
    return qn


# ------------------------------------------------------------------ K-5 Yeo–Johnson

def yeo_johnson(x, lam: float):
    """Column expression of the Yeo–Johnson transform for a fixed λ."""
    pos = x >= 0
    if abs(lam) < 1e-12:
        p = F.log1p(x)
    else:
        p = (F.pow(x + 1, F.lit(lam)) - 1) / lam
    if abs(lam - 2) < 1e-12:
        ng = -F.log1p(-x)
    else:
        ng = -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(pos, p).otherwise(ng)


POWER_SUMS = pa.schema([("k", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("mean", pa.float64()),
                        ("m2", pa.float64()), ("s", pa.float64())])


def yeo_johnson_np(x: np.ndarray, lam: float) -> np.ndarray:
    """``yeo_johnson`` of an array, in no particular order."""
    up = x >= 0
    p, g = np.log1p(x[up]), np.log1p(-x[~up])
    with np.errstate(over="ignore"):
        if abs(lam) >= 1e-12:
            p = np.expm1(lam * p) / lam
        g = -np.expm1((2 - lam) * g) / (2 - lam) if abs(lam - 2) >= 1e-12 else -g
    return np.concatenate([p, g])


def power_moments(df: DataFrame, grids: dict[str, list[float]]) -> DataFrame:
    """(column, i, n, v, s): for each column and λ of its grid the values' number, the population variance of their
    transforms, and Σ sign(x)·ln(1+|x|).  A task adds up its Arrow batches and returns a row a column and λ."""
    names = list(grids)

    def run(batches):
        sums: dict = {}
        for b in batches:
            for k, name in enumerate(names):
                x = b.column(k).drop_null().to_numpy(zero_copy_only=False)
                if not len(x):
                    continue
                s = float(np.sum(np.sign(x) * np.log1p(np.abs(x))))
                for i, lam in enumerate(grids[name]):
                    y = yeo_johnson_np(x, lam)
                    n, mean = len(y), float(y.mean())
                    m2 = float(np.sum((y - mean) ** 2))
                    n0, mean0, m20, s0 = sums.get((k, i), (0, 0.0, 0.0, 0.0))
                    far = mean - mean0
                    sums[k, i] = (n0 + n, mean0 + far * n / (n0 + n), m20 + m2 + far * far * n0 * n / (n0 + n), s0 + s)
        if sums:
            yield pa.RecordBatch.from_pylist([{"k": k, "i": i, "n": n, "mean": mean, "m2": m2, "s": s}
                                              for (k, i), (n, mean, m2, s) in sums.items()], schema=POWER_SUMS)

    part = df.select([c(n).cast("double") for n in names]).mapInArrow(run, "k int, i int, n long, mean double, m2 double, s double")
    w = Window.partitionBy("k", "i")        # a row a task
    n = F.sum("n").over(w)
    part = part.withColumn("far", F.col("mean") - F.sum(F.col("mean") * F.col("n")).over(w) / n)
    return part.groupBy("k", "i").agg(
        F.sum("n").alias("n"), (F.sum(F.col("m2") + F.col("n") * F.col("far") * F.col("far")) / F.sum("n")).alias("v"), F.sum("s").alias("s")) \
        .select(F.array(*[F.lit(x) for x in names])[F.col("k")].alias("column"), "i", "n", "v", "s")


def fit_power(df: DataFrame, cols: list[str], rounds: int = 7, grid: int = 9) -> DataFrame:
    """(column, lambda, mean, std): λ maximising the Yeo–Johnson log-likelihood
    −n/2·ln var(y) + (λ−1)·Σ sign(x)·ln(1+|x|), searched on a grid in [−3, 3] refined
    ``rounds`` times (to 2e-4 with the defaults); every round is one pass for all columns ×
    grid points (``power_moments``)."""
    tr = _train(df).select([c(n) for n in cols]).persist()   # read once per search round
    lo = {n: -3.0 for n in cols}
    hi = {n: 3.0 for n in cols}
    best = {n: 1.0 for n in cols}
    for _ in range(rounds):
        steps = {n: (hi[n] - lo[n]) / (grid - 1) for n in cols}
        got = {(r["column"], r["i"]): r for r in param_rows(power_moments(
            tr, {n: [lo[n] + i * steps[n] for i in range(grid)] for n in cols}))}
        for n in cols:
            step, scores = steps[n], []
            for i in range(grid):
                nn, v, sl = (got[n, i][x] for x in ("n", "v", "s")) if (n, i) in got else (0, None, 0.0)
                lam = lo[n] + i * step
                ll = -nn / 2 * math.log(v) + (lam - 1) * sl if v and v > 0 else -math.inf
                scores.append((ll, lam))
            b = max(scores)[1]
            best[n] = b
            lo[n], hi[n] = b - step, b + step
    spark = df.sparkSession
    lam_df = spark.createDataFrame([(n, float(best[n])) for n in cols], "column string, lambda double")
    # standardise after the transform (population std, 0 → 1)
    lams = {n: best[n] for n in cols}
    y = tr.select([yeo_johnson(c(n).cast("double"), lams[n]).alias(n) for n in cols])
    st = param_rows(fit_scaler(y, cols, "standard"))
    tr.unpersist()
    st_df = spark.createDataFrame([(r["column"], r["center"], r["scale"]) for r in st],
                                  "column string, center double, scale double")
    return lam_df.join(st_df, "column")


def apply_power(df: DataFrame, params: DataFrame) -> DataFrame:
    p = {r["column"]: (r["lambda"], r["center"], r["scale"]) for r in param_rows(params)}
    return df.select([((yeo_johnson(c(n).cast("double"), p[n][0]) - F.lit(p[n][1])) / F.lit(p[n][2])).alias(n)
                      if n in p else c(n) for n in df.columns])


# ------------------------------------------------------------------ K-7 row normalisation

def normalize_rows(df: DataFrame, cols: list[str], norm: str = "l2") -> DataFrame:
    """Row-wise l1 / l2 / max normalisation over ``cols``; a zero row is unchanged."""
    xs = [F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in cols]
    if norm == "l1":
        tot = sum((F.abs(x) for x in xs), F.lit(0.0))
    elif norm == "l2":
        tot = F.sqrt(sum((x * x for x in xs), F.lit(0.0)))
    else:
        tot = F.greatest(*[F.abs(x) for x in xs]) if len(xs) > 1 else F.abs(xs[0])
    d = F.when(tot == 0, F.lit(1.0)).otherwise(tot)
    s = set(cols)
    return df.withColumn("__norm", d).select([(c(n).cast("double") / F.col("__norm")).alias(n) if n in s else c(n)
                                              for n in df.columns])


# ------------------------------------------------------------------ K-8 PCA

def pca_reduce(df: DataFrame, cols: list[str], k: int | None = None, prefix: str = "pca_") -> DataFrame:
    """Centre (train means), ``ml.feature.PCA(k)``, expand to ``pca_i`` columns; k defaults
    to max(2, floor(sqrt(p))).  Signs are fixed so the largest loading is positive."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    p = len(cols)
    k = k or max(2, int(math.floor(math.sqrt(p))))
    means = {r["column"]: r["center"] for r in param_rows(fit_scaler(df, cols, "standard"))}
    cen = df.select(*[c(n) for n in df.columns if n not in cols],
                    *[(F.coalesce(c(n).cast("double"), F.lit(means[n])) - F.lit(means[n])).alias(n) for n in cols])
    va = VectorAssembler(inputCols=cols, outputCol="__v")
    vec = va.transform(cen)
    model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(_train(vec))
    pcs = model.pc.toArray()
    signs = [1.0 if pcs[np.argmax(np.abs(pcs[:, j])), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(vec).withColumn("__a", vector_to_array("__pc"))
    keep = [x for x in df.columns if x not in cols]
    return out.select(*[c(x) for x in keep], *[(F.col("__a")[j] * signs[j]).alias(f"{prefix}{j}") for j in range(k)])


# ------------------------------------------------------------------ K-9

def constant_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column): columns with ≤ 1 distinct value counting NULL as a value."""
    cols = cols or [n for n in df.columns if not n.startswith("_")]
    wide = df.agg(*[(F.count_distinct(c(n)) + F.max(c(n).isNull().cast("int"))).alias(n) for n in cols])
    return wide.unpivot([], qcols(cols), "column", "k").where(F.col("k") <= 1).select("column")


def drop_constant(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    drop = [r["column"] for r in param_rows(constant_columns(df, cols))]
    return df.drop(*drop)
