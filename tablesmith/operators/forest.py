"""Random forests of numbers for the large path (M-1), over histograms.

The forest is the one that ``RandomForestRegressor`` grows: bags of Poisson weights, a random third of the features
for each node, the split of the largest drop of variance, means as predictions.  Features are cut into at most ``bins``
bins at approximate quantiles.  Rows are written once in blocks: the different vectors of bins, and for each row its
number and which of them it has.  For every level a pass draws the bags of a block again from its number, adds up the
rows' weights and labels by vector, and those by (tree, node, feature, bin), first within each task and then across tasks;
the driver gets one row a cell, whatever the table holds, and picks the splits.  No row keeps a weight for every tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .boost import fit_edges

BLOCK_ROWS = 100_000
DRAWN = 1 << 16         # a weight is looked up by a draw of 16 bits
BLOCK = "cells binary, at binary, y binary"


def poisson_weights() -> np.ndarray:
    """Weights for each draw: k as often as Poisson of mean 1 has it, to one part in ``DRAWN``."""
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(below, (np.arange(DRAWN) + 0.5) / DRAWN).astype(np.float64)


@dataclass
class Forest:
    """Complete binary trees in arrays (tree, node): node k has the children 2k + 1 and 2k + 2; feature -1 ends a branch."""

    edges: list[np.ndarray]
    vector: str
    feature: np.ndarray
    at: np.ndarray          # bins up to this one go left
    value: np.ndarray
    gains: np.ndarray       # (tree, feature): drop of the squared error

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def nodes(self, tree: int, bins: np.ndarray, steps: int) -> np.ndarray:
        """The node that each row has reached after ``steps`` levels."""
        feature, at, flat = self.feature[tree], self.at[tree], bins.ravel()
        start, node = np.arange(len(bins)) * bins.shape[1], np.zeros(len(bins), np.int64)
        for _ in range(steps):
            f = feature[node]
            right = flat[start + np.maximum(f, 0)] > at[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    @property
    def depth(self) -> int:
        return self.feature.shape[1].bit_length() - 1

    @property
    def featureImportances(self) -> DenseVector:        # noqa: N802, the name that MLlib's models have
        """Shares of the gains of each tree, averaged."""
        total = self.gains.sum(axis=1, keepdims=True)
        shares = np.divide(self.gains, total, out=np.zeros_like(self.gains), where=total > 0).sum(axis=0)
        return Vectors.dense(shares / shares.sum() if shares.sum() > 0 else shares)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, the mean of the trees."""
        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=np.float64)
            bins = self.binned(np.stack(x.to_numpy()))
            return pd.Series(sum(self.value[t][self.nodes(t, bins, self.depth)] for t in range(len(self.value))) / len(self.value))

        return df.withColumn("prediction", run(vector_to_array(self.vector)))


def packed(data: DataFrame, label: str, forest: Forest, mean: float) -> DataFrame:
    """Written blocks of about ``BLOCK_ROWS`` rows of a task, numbered: different vectors of bins, and for each row
    which of them it has and its label less ``mean``."""
    def block(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        bins = np.ascontiguousarray(forest.binned(x))
        if bins.shape[1] <= 7:      # a vector is one number
            _, first, at = np.unique((bins.astype(np.int64) << (8 * np.arange(bins.shape[1]))).sum(axis=1), return_index=True, return_inverse=True)
        else:
            _, first, at = np.unique(bins.view(f"V{bins.shape[1]}").ravel(), return_index=True, return_inverse=True)
        made = bins[first].tobytes(), at.astype(np.uint32).tobytes(), (y - mean).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in made], ["cells", "at", "y"])

    def blocks(batches):
        held, n = [], 0
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            held.append((x, b.column(0).to_numpy()))
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield block(*(np.concatenate(v) for v in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield block(*(np.concatenate(v) for v in zip(*held, strict=True)))

    rows = data.select(F.col(label).alias("y"), vector_to_array(forest.vector).alias("x")).mapInArrow(blocks, BLOCK)
    return checkpoint(rows.withColumn("block", F.monotonically_increasing_id()))


def level_sums(rows: DataFrame, forest: Forest, tried: np.ndarray, level: int, bins: int, seed: int) -> np.ndarray:
    """(2, trees, nodes of the level, features tried, bins): sums of weights, and of weighted labels."""
    n_trees, nodes, n_tried = tried.shape
    first, size = nodes - 1, nodes * n_tried * bins
    held = rows.sparkSession.sparkContext.broadcast((forest, tried, poisson_weights()))

    def add(batches):
        f, tried, weights = held.value
        total = np.zeros((2, n_trees, size))
        for b in batches:
            for cells, at, y, number in zip(*(b.column(k) for k in range(4)), strict=True):
                x = np.frombuffer(cells.as_py(), np.uint8).reshape(-1, len(f.edges))
                at, y = np.frombuffer(at.as_py(), np.uint32).astype(np.int64), np.frombuffer(y.as_py(), np.float64)
                for t in range(n_trees):
                    drawn = np.random.Generator(np.random.SFC64([seed, t, number.as_py()])).integers(0, DRAWN, len(y), np.uint16)
                    w = weights[drawn]
                    sums = np.bincount(at, w, len(x)), np.bincount(at, w * y, len(x))
                    node = f.nodes(t, x, level) - first         # below 0: on an ended branch
                    live = np.flatnonzero((node >= 0) & (sums[0] > 0))
                    node = node[live]
                    for j in range(n_tried):
                        k = (node * n_tried + j) * bins + x[live, tried[t, node, j]]
                        for i in (0, 1):
                            total[i, t] += np.bincount(k, sums[i][live], size)
        total = total.reshape(2, -1)
        cell = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[0][cell]), pa.array(total[1][cell])], ["cell", "w", "s"])

    got = rows.select("cells", "at", "y", "block").mapInArrow(add, "cell long, w double, s double") \
        .groupBy("cell").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).toArrow()       # a row a cell
    held.destroy()
    out = np.zeros((2, n_trees * size))
    out[0][got["cell"].to_numpy()], out[1][got["cell"].to_numpy()] = got["w"].to_numpy(), got["s"].to_numpy()
    return out.reshape(2, n_trees, nodes, n_tried, bins)


def grow_level(forest: Forest, sums: np.ndarray, tried: np.ndarray, level: int, mean: float, least: float) -> bool:
    """The best split of each node of the level, of a drop of more than ``least`` a row, and its children's means."""
    first, any_ = (1 << level) - 1, False
    for t in range(len(tried)):
        for node in range(first, first + (1 << level)):
            w, s = sums[0, t, node - first], sums[1, t, node - first]
            n, total = w[0].sum(), s[0].sum()
            if n <= 0:
                continue
            if not level:
                forest.value[t, 0] = mean + total / n
            lw, ls = np.cumsum(w, axis=1)[:, :-1], np.cumsum(s, axis=1)[:, :-1]
            rw, rs = n - lw, total - ls
            fine = (lw >= 1) & (rw >= 1)        # weights are whole numbers
            gain = np.where(fine, ls ** 2 / np.where(fine, lw, 1) + rs ** 2 / np.where(fine, rw, 1) - total ** 2 / n, 0.0)
            j, at = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, at] <= least * n:
                continue
            f = tried[t, node - first, j]
            forest.feature[t, node], forest.at[t, node], any_ = f, at, True
            forest.gains[t, f] += gain[j, at]
            forest.value[t, 2 * node + 1], forest.value[t, 2 * node + 2] = mean + ls[j, at] / lw[j, at], mean + rs[j, at] / rw[j, at]
    return any_


def fit_forest(data: DataFrame, label: str, vector: str, trees: int = 100, depth: int = 5, bins: int = 32, seed: int = 42) -> Forest:
    """``data``: a number and a vector of finite numbers, a written table."""
    n_features = len(data.select(vector).first()[0])
    wide = data.select(label, *[vector_to_array(vector)[k].alias(f"x{k}") for k in range(n_features)])
    edges = fit_edges(wide, [f"x{k}" for k in range(n_features)], bins + 1)     # bins - 1 edges
    mean, var, gaps = data.agg(F.avg(label), F.var_pop(label), F.count_if(F.col(label).isNull() | F.isnan(label))).first()
    if gaps:
        raise ValueError(f"{gaps} labels are NULL or NaN")
    size = (1 << (depth + 1)) - 1
    forest = Forest(edges, vector, np.full((trees, size), -1), np.zeros((trees, size), np.int64), np.zeros((trees, size)),
                    np.zeros((trees, n_features)))
    rows, rng = packed(data, label, forest, mean), np.random.default_rng(seed)
    n_tried = n_features if trees == 1 else -(-n_features // 3)
    for level in range(depth):
        tried = rng.random((trees, 1 << level, n_features)).argsort(axis=2)[:, :, :n_tried]
        if not grow_level(forest, level_sums(rows, forest, tried, level, bins, seed), tried, level, mean, 1e-12 * var):
            break
    return forest
