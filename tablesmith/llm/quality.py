"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text come from its bytes, for many documents at once.  Training rows
are a bounded sample (``MAX_TRAIN_ROWS`` labelled rows, chosen by a hash of doc_id); their
statistics, a few megabytes, reach the driver, which fits the trees in numpy.  The trees are
flattened into arrays (feature, threshold, leaf) that walk all rows of a batch one level at a
time.  Scoring is one map over the documents: no shuffle, nothing kept.

Defined cases: a null text is an empty one and gets a score too; labels that are null, not 0
or 1, or of unknown documents are not used; several labels of a document count each; without
any usable label every score is 0.5, with one class only the smoothed share of that class;
repeated rows get equal scores; extra columns are passed through by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, pieces, prefix_hash, ship, span_hash, text_view, word_spans

MAX_TRAIN_ROWS = 20_000
BINS, DEPTH, TREES, RATE, LEAF_L2, LEAF_MIN = 64, 4, 120, 0.12, 2.0, 10

CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "high": range(0x80, 0x100),
    "stop": b".,;:", "shout": b"!?", "symbol": b"#$%&*@^~+=", "bracket": b"<>{}[]()/\\", "bar": b"|", "quote": b"\"'`-_",
    "space": [32, *range(9, 14)], "line": b"\n", "control": [*range(0, 9), *range(14, 32), 127],
}
NAMES = ["log_bytes", "log_words", "word_mean", "word_max", "log_lines", "line_mean", "distinct_words", "top_word",
         "repeat_next", "distinct_pairs", "distinct_lines", "capital_words", "shout_words", "stop_words", "plain_words",
         *(f"share_{c}" for c in CLASSES)]


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of values first[r]:first[r+1]: share of distinct values, share of the most frequent one."""
    distinct, top = np.ones(len(first) - 1), np.zeros(len(first) - 1)
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a > 1:
            s = np.sort(h[a:b])
            at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            distinct[r] = len(at) / (b - a)
            top[r] = np.diff(np.append(at, b - a)).max() / (b - a)
    return distinct, top


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """float32 matrix of ``NAMES`` for the texts data[offs[i]:offs[i+1]]."""
    out = np.zeros((len(offs) - 1, len(NAMES)), np.float32)
    for i, j in pieces(offs):
        part, rel = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        size = np.diff(rel)
        per = np.maximum(size, 1)
        counts = []
        for chars in CLASSES.values():
            lut = np.zeros(256, np.int32)
            lut[list(chars)] = 1
            counts.append(np.diff(np.append(0, np.cumsum(lut[part]))[rel]))
        ws, we, first = word_spans(part, offs[i:j + 1], ~SPACES)
        n = np.diff(first)
        words = np.maximum(n, 1)
        h = span_hash(prefix_hash(part), ws, we)
        row = np.repeat(np.arange(j - i), n)
        width = we - ws
        newline = np.zeros(256, bool)
        newline[10] = True
        ls, le, lfirst = word_spans(part, offs[i:j + 1], ~newline)
        lines = np.maximum(np.diff(lfirst), 1)

        def share(flag, row=row, words=words, n=n):
            return np.bincount(row, flag, minlength=len(n)) / words

        initial, final = part[ws], part[we - 1]
        second = part[np.minimum(ws + 1, we - 1)]
        is_upper = (initial >= 0x41) & (initial <= 0x5A)
        inside = np.append(row[1:] == row[:-1], False) if len(h) else np.zeros(0, bool)
        pairs = np.where(inside, np.append(h[1:], h[:1]) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0)) + h
        next_same = inside & (np.append(h[1:], h[:1]) == h)
        distinct, top = _distinct(h, first)
        longest = np.zeros(j - i)
        np.maximum.at(longest, row, width)
        m = out[i:j]
        m[:, 0], m[:, 1] = np.log1p(size), np.log1p(n)
        m[:, 2], m[:, 3] = share(width), np.log1p(longest)
        m[:, 4], m[:, 5] = np.log1p(lines), np.log1p(size / lines)
        m[:, 6], m[:, 7], m[:, 8] = distinct, top, share(next_same)
        m[:, 9] = _distinct(pairs, first)[0]
        m[:, 10] = _distinct(span_hash(prefix_hash(part), ls, le), lfirst)[0]
        m[:, 11] = share(is_upper)
        m[:, 12] = share(is_upper & (second >= 0x41) & (second <= 0x5A))
        m[:, 13] = share(np.isin(final, np.frombuffer(b".,;:", np.uint8)))
        m[:, 14] = share(((final >= 0x61) & (final <= 0x7A)) | (final >= 0x80))
        for k, c in enumerate(counts):
            m[:, 15 + k] = c / per
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays; node k has children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray      # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray         # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            f += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-f))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log loss; splits are searched over ``BINS`` quantile bins."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    columns, f = x.shape[1], np.full(len(y), base)
    flat = binned + np.arange(columns) * BINS
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        for depth in range(DEPTH):
            low, width = 2 ** depth - 1, 2 ** depth
            at = ((node - low)[:, None] * (columns * BINS) + flat).ravel()
            shape = (width, columns, BINS)
            sums = [np.bincount(at, np.repeat(w, columns), width * columns * BINS).reshape(shape).cumsum(axis=2)
                    for w in (g, h, np.ones(len(y)))]
            gl, hl, nl = sums
            gt, ht, nt = (s[:, :, -1:] for s in sums)
            gain = gl ** 2 / (hl + LEAF_L2) + (gt - gl) ** 2 / (ht - hl + LEAF_L2) - gt ** 2 / (ht + LEAF_L2)
            gain[(nl < LEAF_MIN) | (nt - nl < LEAF_MIN)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                c, b = divmod(int(best[k]), BINS)
                if gain[k, c, b] > 1e-9 and b < len(edges[c]):
                    feature[low + k], threshold[low + k], cut[low + k] = c, edges[c][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + LEAF_L2)
        f += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def train(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, label: str = "quality",
          text: str = "text", doc_id: str = "doc_id", max_rows: int = MAX_TRAIN_ROWS) -> Trees:
    """Fit on at most about ``max_rows`` labelled rows; ``train_rows`` is a condition on column
    doc_id that says which labels may be used."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")) \
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    if train_rows is not None:
        known = known.where(train_rows)
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(max_rows / n * 1_000_003))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    d = d.join(F.broadcast(known), "doc_id").select("y", "text")     # max_rows rows of 12 bytes
    schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float32()))])

    def run(batches):
        for b in batches:
            x = statistics(*text_view(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float32()))],
                                             schema=schema)

    rows = ship(d).mapInArrow(run, "y int, x array<float>").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    y = rows["y"].to_numpy()
    order = np.lexsort((*x.T, y))       # the same trees however the rows arrive
    return fit(x[order].astype(np.float64), y[order].astype(np.float64))


def score(docs: DataFrame, model: Trees, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for b in batches:
            s = held.value.score(statistics(*text_view(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             schema=schema)

    return ship(d).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` that the model does not reject."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(held.value.score(statistics(*text_view(b.column(at)))) >= threshold))

    return ship(docs).mapInArrow(run, docs.schema)
