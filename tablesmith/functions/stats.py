"""Statistical expressions that Spark lacks as built-ins, written as Column math so they
stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness G1 from Spark's population ``skewness`` (n<3 → NULL)."""
    n = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population ``kurtosis`` (n<4 → NULL)."""
    n = n.cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation that returns NULL for a constant input instead of raising
    under ANSI mode (pairwise-complete rows only)."""
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x.cast("double"))
    yy = F.when(both, y.cast("double"))
    return F.try_divide(F.covar_samp(xx, yy), F.stddev_samp(xx) * F.stddev_samp(yy))


def rnd(x: Column, digits: int) -> Column:
    """round(x, d) computed as round(x·10^d)/10^d on doubles (half away from zero on the
    binary value) — the reports' rounding, identical to DuckDB's ``round``."""
    m = float(10 ** digits)
    return F.round(x.cast("double") * m) / m + F.lit(0.0)   # no negative zero


def log2(x: Column) -> Column:
    return F.log(2.0, x)


def norm_ppf_np(p):
    """Inverse standard normal CDF (Acklam's rational approximation refined by one
    Newton step); works on numpy arrays.  Used inside Arrow-batched pandas UDFs."""
    import numpy as np
    p = np.asarray(p, dtype="float64")
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    cc = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
          -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]
    plow, phigh = 0.02425, 1 - 0.02425
    x = np.full_like(p, np.nan)
    lo = p < plow
    hi = p > phigh
    mid = ~(lo | hi)
    ql = np.sqrt(-2 * np.log(p[lo]))
    x[lo] = (((((cc[0]*ql+cc[1])*ql+cc[2])*ql+cc[3])*ql+cc[4])*ql+cc[5]) / \
        ((((d[0]*ql+d[1])*ql+d[2])*ql+d[3])*ql+1)
    qm = p[mid] - 0.5
    r = qm * qm
    x[mid] = (((((a[0]*r+a[1])*r+a[2])*r+a[3])*r+a[4])*r+a[5])*qm / \
        (((((b[0]*r+b[1])*r+b[2])*r+b[3])*r+b[4])*r+1)
    qh = np.sqrt(-2 * np.log(1 - p[hi]))
    x[hi] = -(((((cc[0]*qh+cc[1])*qh+cc[2])*qh+cc[3])*qh+cc[4])*qh+cc[5]) / \
        ((((d[0]*qh+d[1])*qh+d[2])*qh+d[3])*qh+1)
    # one Halley refinement with the exact CDF via erfc
    from math import erfc
    verfc = np.vectorize(erfc, otypes=[float])
    e = 0.5 * verfc(-x / math.sqrt(2)) - p
    u = e * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
    return x - u / (1 + x * u / 2)


def norm_cdf_np(x):
    import numpy as np
    from math import erfc
    verfc = np.vectorize(erfc, otypes=[float])
    return 0.5 * verfc(-np.asarray(x, dtype="float64") / math.sqrt(2))
