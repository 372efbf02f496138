"""Shapiro–Wilk normality flag per column (P-8).

Each numeric column contributes a bounded, hash-chosen sample of ≤ 5,000 values (exact
rank by hash among the rows of the lowest hashes), and one
``groupBy(column).applyInPandas`` computes W and its p-value per column in parallel with
Royston's (1995) approximation.  The statistic is only ever computed on the bounded
sample, as in the definition of the check.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import norm_cdf_np, norm_ppf_np
from ..functions.types import c
from .sample import low_hashes


def shapiro_w(x: np.ndarray) -> tuple[float, float]:
    """W and p-value (Royston 1995) for 3 ≤ n ≤ 5000."""
    x = np.sort(np.asarray(x, dtype="float64"))
    n = len(x)
    if n < 3 or np.ptp(x) == 0:
        return float("nan"), float("nan")
    m = norm_ppf_np((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    mm = float(np.dot(m, m))
    u = 1.0 / math.sqrt(n)
    a = m / math.sqrt(mm)
    if n > 3:
        an = (-2.706056 * u ** 5 + 4.434685 * u ** 4 - 2.071190 * u ** 3 - 0.147981 * u ** 2
              + 0.221157 * u + a[-1])
        if n > 5:
            an1 = (-3.582633 * u ** 5 + 5.682633 * u ** 4 - 1.752461 * u ** 3 - 0.293762 * u ** 2
                   + 0.042981 * u + a[-2])
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
            a = m / math.sqrt(phi)
            a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
            a = m / math.sqrt(phi)
            a[-1], a[0] = an, -an
    else:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    w = float(np.dot(a, x) ** 2 / np.sum((x - x.mean()) ** 2))
    w = min(w, 1.0)
    if n == 3:
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return w, p
    y = math.log(1 - w) if w < 1 else -math.inf
    lnn = math.log(n)
    if n <= 11:
        gamma = 0.459 * n - 2.273
        mu = 0.544 - 0.39978 * n + 0.025054 * n ** 2 - 0.0006714 * n ** 3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n ** 2 - 0.0020322 * n ** 3)
        y = -math.log(gamma - y) if gamma - y > 0 else math.inf
    else:
        mu = -1.5861 - 0.31082 * lnn - 0.083751 * lnn ** 2 + 0.0038915 * lnn ** 3
        sigma = math.exp(-0.4803 - 0.082676 * lnn + 0.0030302 * lnn ** 2)
    z = (y - mu) / sigma
    return w, float(1 - norm_cdf_np([z])[0])


def shapiro_flags(df: DataFrame, cols: list[str], sample: int = 5000, seed=42, key: str = "_rid") -> DataFrame:
    """(column, n, w, p_value, is_normal): constant columns count as normal."""
    x = [c(n).cast("double") for n in cols]
    lv = low_hashes(df.select(key, *[F.when(~F.isnan(v), v).alias(n) for n, v in zip(cols, x, strict=True)]), cols, sample, key, seed)
    w = Window.partitionBy("column").orderBy("_h", key)     # rows of one id come together, as in take_by_hash
    s = lv.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= sample).select("column", "value")

    def per_column(pdf: pd.DataFrame) -> pd.DataFrame:
        vals = pdf["value"].to_numpy()
        if len(vals) >= 3 and np.ptp(vals) == 0:
            return pd.DataFrame({"column": [pdf["column"].iloc[0]], "n": [len(vals)], "w": [1.0], "p_value": [1.0],
                                 "is_normal": [True]})
        wv, p = shapiro_w(vals)
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "n": [len(vals)], "w": [wv], "p_value": [p],
                             "is_normal": [bool(p > 0.05) if not math.isnan(p) else None]})

    return s.groupBy("column").applyInPandas(per_column, "column string, n long, w double, p_value double, is_normal boolean")
