"""Pairwise moments of many columns in one scan (R-1, R-2, R-7, C-9).

Each task turns its batches into matrices over all pairs of columns: rows where both have a value,
the means, squares and cross products there (products of masked matrices, so the work is done by
the linear algebra library), centred by the pair's own means and merged without loss of digits.
The tasks' matrices are merged row by row in two steps, so no merge holds more than some hundred
of them, and the driver gets one row a column.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import c

FAN_IN = 256


@dataclass
class Moments:
    """For columns a (first axis) and b over the rows that have both: how many, the means of a and of b, the sum of
    squares of a and of products of a and b around their means.  All of one shape."""

    n: np.ndarray
    mean_a: np.ndarray
    mean_b: np.ndarray
    square: np.ndarray
    cross: np.ndarray

    def merge(self, o: Moments) -> Moments:
        n = self.n + o.n
        share = np.divide(o.n, n, out=np.zeros_like(n), where=n > 0)
        da, db, both = o.mean_a - self.mean_a, o.mean_b - self.mean_b, self.n * share
        return Moments(n, self.mean_a + da * share, self.mean_b + db * share,
                       self.square + o.square + da * da * both, self.cross + o.cross + da * db * both)


NAMES = [f.name for f in fields(Moments)]
SCHEMA = "row int, part int, " + ", ".join(f"{n} binary" for n in NAMES)


def moments_of(x: np.ndarray) -> Moments:
    """Of the rows of a matrix; NaN is missing."""
    has = ~np.isnan(x)
    m = has.astype(np.float64)
    n, rows = m.T @ m, m.sum(axis=0)
    shift = np.divide(np.where(has, x, 0.0).sum(axis=0), rows, out=np.zeros(x.shape[1]), where=rows > 0)
    z = np.where(has, x - shift, 0.0)
    total = z.T @ m                                     # of a, where b is there
    mean = np.divide(total, n, out=np.zeros_like(n), where=n > 0)
    square = np.maximum((z * z).T @ m - total * mean, 0.0)
    return Moments(n, mean + shift[:, None], mean.T + shift[None, :], square, z.T @ z - mean * total.T)


def _rows(m: Moments, part: int) -> pa.RecordBatch:
    d = len(m.n)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(d), pa.int32()), pa.array([part] * d, pa.int32()),
         *(pa.array([r.tobytes() for r in getattr(m, k)], pa.binary()) for k in NAMES)], ["row", "part", *NAMES])


def _merge(t: pa.Table) -> pa.Table:
    got = None
    for r in t.select(NAMES).to_pylist():
        m = Moments(*(np.frombuffer(r[k]) for k in NAMES))
        got = m if got is None else got.merge(m)
    return pa.table([t["row"].slice(0, 1), pa.array([0], pa.int32()), *(pa.array([getattr(got, k).tobytes()], pa.binary()) for k in NAMES)],
                    ["row", "part", *NAMES])


def gram(df: DataFrame, cols: list[str]) -> Moments:
    """The moments of all pairs of ``cols`` (numeric; NaN and infinite values are missing)."""
    d = len(cols)
    x = [c(n).cast("double") for n in cols]
    x = [F.when(F.abs(v) < float("inf"), v).alias(f"x{i}") for i, v in enumerate(x)]

    def add(batches):
        got = None
        for b in batches:
            m = moments_of(np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(d)]))
            got = m if got is None else got.merge(m)
        if got is not None:
            yield _rows(got, TaskContext.get().partitionId() // FAN_IN)

    parts = df.select(x).mapInArrow(add, SCHEMA).groupBy("row", "part").applyInArrow(_merge, SCHEMA)
    rows = parts.groupBy("row").applyInArrow(_merge, SCHEMA).collect()      # a row a column
    out = Moments(*(np.zeros((d, d)) for _ in NAMES))
    for r in rows:
        for k in NAMES:
            getattr(out, k)[r["row"]] = np.frombuffer(r[k])
    return out


def correlations(m: Moments) -> np.ndarray:
    """Pearson's r of every pair; NaN where a column does not vary over the pair's rows."""
    small = 1e-24 * m.n * np.maximum(m.mean_a ** 2, 1e-300)
    flat = (m.n < 2) | (m.square <= small) | (m.square.T <= small.T)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = m.cross / np.sqrt(m.square * m.square.T)
    return np.where(flat, np.nan, np.clip(r, -1.0, 1.0))
