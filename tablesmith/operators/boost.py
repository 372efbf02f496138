"""Gradient boosted trees over histograms, any number of classes (M-5).

One tree per class and round for the softmax objective, one per round for two classes
(logistic) and for numbers (squared error).  Values are cut into at most ``bins`` bins at
approximate quantiles; missing values are the lowest bin.  All trees of a round grow together: a
pass over the rows adds up gradients and second derivatives by (tree, node, feature, bin) within
each task and then across tasks, and the driver, which gets one number a cell whatever the table
holds, picks the best split of every node.  Rows carry their scores in a written table that is
renewed every ``CUT`` rounds, so a pass replays the trees since then and not the whole model.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import c
from ..session import checkpoint

CUT = 10
ROWS_A_TASK = 200_000
ROW = "label double, bins binary, scores array<double>"


@dataclass
class Tree:
    """A complete binary tree in arrays: node k has the children 2k + 1 and 2k + 2; feature -1 ends a branch."""

    feature: np.ndarray
    at: np.ndarray          # bins up to this one go left
    value: np.ndarray


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    task: str
    classes: int
    base: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bin numbers of rows by features: 0 is missing, k + 1 the k-th interval between edges."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for k, (x, e) in enumerate(zip(columns, self.edges, strict=True)):
            out[:, k] = np.where(np.isnan(x), 0, np.searchsorted(e, x, "left") + 1)
        return out

    def scores(self, bins: np.ndarray, rounds: list | None = None) -> np.ndarray:
        out = np.zeros((len(bins), len(self.base)))
        for trees in self.rounds if rounds is None else rounds:
            for k, t in enumerate(trees):
                out[:, k] += t.value[leaves(t, bins)]
        return out

    def importance(self) -> list[tuple[str, int]]:
        """(feature, number of splits), most first."""
        n = np.zeros(len(self.features), np.int64)
        for trees in self.rounds:
            for t in trees:
                np.add.at(n, t.feature[t.feature >= 0], 1)
        return sorted(zip(self.features, n.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def leaves(t: Tree, bins: np.ndarray) -> np.ndarray:
    """The node that each row ends in."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while True:
        f = t.feature[node]
        live = f >= 0
        if not live.any():
            return node
        right = bins[rows, np.maximum(f, 0)] > t.at[node]
        node = np.where(live, 2 * node + 1 + right, node)


def probabilities(scores: np.ndarray, task: str, classes: int) -> np.ndarray:
    if task == "regression":
        return scores
    if classes == 2:
        p = 1.0 / (1.0 + np.exp(-scores[:, 0]))
        return np.stack([1.0 - p, p], axis=1)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(scores: np.ndarray, label: np.ndarray, task: str, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the scores, one column a tree."""
    if task == "regression":
        return scores - label[:, None], np.ones_like(scores)
    p = probabilities(scores, task, classes)
    if classes == 2:
        p = p[:, 1:]
        return p - label[:, None], np.maximum(p * (1 - p), 1e-16)
    return p - (label[:, None] == np.arange(classes)), np.maximum(p * (1 - p), 1e-16)


def fit_edges(df: DataFrame, features: list[str], bins: int = 64, accuracy: int = 10_000) -> list[np.ndarray]:
    """Bin edges at approximate quantiles, one bounded sketch a feature."""
    at = [k / (bins - 1) for k in range(1, bins - 1)]
    x = {n: F.when(~F.isnan(c(n).cast("double")), c(n).cast("double")) for n in features}
    row = df.agg(*[F.percentile_approx(x[n], F.array(*[F.lit(p) for p in at]), accuracy).alias(f"e{i}")
                   for i, n in enumerate(features)]).first()
    return [np.unique(np.array(e or [], np.float64)) for e in row]


def unpacked(b: pa.RecordBatch, n_features: int, n_trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and scores of a batch's rows."""
    x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, n_features)
    return x, b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n_trees)


def level_sums(rows: DataFrame, model: Boosted, since: list, growing: list[Tree], level: int, tasks: int) -> np.ndarray:
    """(2, trees, nodes of the level, features, bins): sums of first and second derivatives."""
    n_trees, n_features = len(model.base), len(model.features)
    nodes, first = 1 << level, (1 << level) - 1
    n_bins = max((len(e) for e in model.edges), default=0) + 2
    size = n_trees * nodes * n_features * n_bins
    held = rows.sparkSession.sparkContext.broadcast((replace(model, rounds=[]), since, growing))  # CUT rounds at most

    def add(batches):
        m, replay, trees = held.value
        total = np.zeros((2, n_trees, size // n_trees))
        for b in batches:
            x, s = unpacked(b, n_features, n_trees)
            s = s + m.scores(x, replay)
            g, h = gradients(s, b.column(0).to_numpy(), m.task, m.classes)
            for k, t in enumerate(trees):
                node = leaves(t, x)
                here = np.flatnonzero(node >= first)        # the others stand on an ended branch
                cell = (node[here] - first)[:, None] * n_features + np.arange(n_features)
                at = (cell * n_bins + x[here]).ravel()
                total[0, k] += np.bincount(at, np.repeat(g[here, k], n_features), size // n_trees)
                total[1, k] += np.bincount(at, np.repeat(h[here, k], n_features), size // n_trees)
        total = total.reshape(2, size)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["cell", "g", "h"])

    got = rows.mapInArrow(add, "cell long, g double, h double")
    if tasks > 1:
        got = got.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    out = np.zeros((2, size))
    t = got.toArrow()       # a row a cell
    held.destroy()
    out[0][t["cell"].to_numpy()], out[1][t["cell"].to_numpy()] = t["g"].to_numpy(), t["h"].to_numpy()
    return out.reshape(2, n_trees, nodes, n_features, n_bins)


def grow_level(trees: list[Tree], sums: np.ndarray, level: int, l2: float, least: float, rate: float) -> bool:
    """The best splits of the level's nodes and the values of their children (ties: first feature, then lowest
    bin).  True if a node was split."""
    first, any_ = (1 << level) - 1, False
    for k, t in enumerate(trees):
        for node in range(first, first + (1 << level)):
            g, h = sums[0, k, node - first], sums[1, k, node - first]
            total_g, total_h = g[0].sum(), h[0].sum()
            if total_h <= 0:
                continue
            if not level:
                t.value[0] = -rate * total_g / (total_h + l2)
            left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g ** 2 / (left_h + l2) + right_g ** 2 / (right_h + l2) - total_g ** 2 / (total_h + l2)
            gain = np.round(np.where((left_h >= least) & (right_h >= least), gain, 0.0), 9)
            f, at = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, at] <= 1e-9:
                continue
            t.feature[node], t.at[node], any_ = f, at, True
            t.value[2 * node + 1] = -rate * left_g[f, at] / (left_h[f, at] + l2)
            t.value[2 * node + 2] = -rate * right_g[f, at] / (right_h[f, at] + l2)
    return any_


def fit_boosted(df: DataFrame, label: str, features: list[str], task: str = "classification", classes: int = 2,
                rounds: int = 100, depth: int = 6, rate: float = 0.3, l2: float = 1.0, least: float = 1.0,
                bins: int = 64) -> Boosted:
    """``label``: a number, or the class from 0 to ``classes`` - 1; rows without one are left out.
    ``least``: second derivatives a child must hold."""
    df = df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    edges = fit_edges(df, features, bins)
    base = np.zeros(1 if task == "regression" or classes == 2 else classes)
    if task == "regression":
        base[0] = df.agg(F.avg(label)).first()[0] or 0.0
    model = Boosted(features, edges, task, classes, base)

    def binned(batches):
        for b in batches:
            x = model.binned([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(features))])
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), rows, pa.array([base.tolist()] * b.num_rows, pa.list_(pa.float64()))], ["label", "bins", "scores"])

    def renewed(since):
        held = (replace(model, rounds=[]), since)

        def add(batches):
            m, replay = held
            for b in batches:
                x, s = unpacked(b, len(features), len(base))
                s = s + m.scores(x, replay)
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(base))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(s.ravel()))],
                                                 ["label", "bins", "scores"])
        return add

    x = [F.coalesce(c(n).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, n in enumerate(features)]
    rows = df.select(F.col(label).cast("double").alias("label"), *x).mapInArrow(binned, ROW)
    tasks = -(-df.count() // ROWS_A_TASK) or 1
    rows = checkpoint(rows.repartition(tasks))      # even tasks; a small table is one, as a pass is short
    since: list = []
    for k in range(rounds):
        trees = [Tree(np.full(2 ** (depth + 1) - 1, -1, np.int64), np.zeros(2 ** (depth + 1) - 1, np.int64),
                      np.zeros(2 ** (depth + 1) - 1)) for _ in base]
        for level in range(depth):
            if not grow_level(trees, level_sums(rows, model, since, trees, level, tasks), level, l2, least, rate):
                break
        model.rounds.append(trees)
        since = [*since, trees]
        if len(since) == CUT and k + 1 < rounds:
            rows, since = checkpoint(rows.mapInArrow(renewed(since), ROW)), []
    return model


def probability(model: Boosted) -> Column:
    """array<double>: the classes' probabilities of a row, or the predicted number alone."""
    held = model

    @F.pandas_udf("array<double>")
    def run(x: pd.DataFrame) -> pd.Series:
        bins = held.binned([x.iloc[:, k].to_numpy(np.float64, na_value=np.nan) for k in range(x.shape[1])])
        return pd.Series(list(probabilities(held.base + held.scores(bins), held.task, held.classes)))

    return run(F.struct(*[c(n).cast("double").alias(f"x{i}") for i, n in enumerate(model.features)]))


def predict(df: DataFrame, model: Boosted) -> DataFrame:
    """``df`` with ``probability`` and ``prediction`` (the first class of the highest probability, or the number)."""
    out = df.withColumn("probability", probability(model))
    if model.task == "regression":
        return out.withColumn("prediction", F.col("probability")[0])
    return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))
