"""Helpers shared by the operators of this subpackage.

Texts reach Python as Arrow buffers.  The helpers below view a column's UTF-8 bytes as one
numpy array and find words and rolling hashes for many documents at once, so no Python
object is made per word.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.session import checkpoint

# odd multipliers: they have an inverse modulo 2^64
BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xD1342543DE82EF95
ROUTE_BASE = 0xAF251AF3B0F025B5
PIECE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared ``spark.checkpoint.dir`` and read it back."""
    return checkpoint(df)


_SHIPPED: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """``df``, after this package's code was given to the executors (once per application), so
    that Python functions run there also where the package is not installed.  Arrow batches are
    held to ``BATCH_BYTES``, as ten thousand long documents would not fit a worker."""
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(size) in ("-1", "67108864", "64MB", "2147483647"):      # not chosen by the user
        conf.set(size, str(BATCH_BYTES))
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="tablesmith-code-"), "tablesmith_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return df


def text_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset:col.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def pieces(offs: np.ndarray, limit: int = PIECE_BYTES):
    """Ranges (i, j) of rows holding about ``limit`` bytes; one longer row is a piece alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
    """Byte starts and ends of all words, and the first word's number of each row (n + 1 values).

    ``data`` holds the bytes from offs[0] to offs[-1]; a row's end ends a word.
    """
    rel = offs - offs[0]
    w = is_word[data]
    before = np.zeros(len(w) + 1, bool)
    before[1:] = w
    before[rel] = False
    after = np.zeros(len(w) + 1, bool)
    after[:-1] = w
    after[rel] = False
    starts = np.flatnonzero(w & ~before[:-1])
    ends = np.flatnonzero(w & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, rel)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int):
    if len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES + (1 << 16))
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of (value + 1) * BASE^position modulo 2^64, for ``span_hash``."""
    pw, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * pw[:len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of values[start:end], the same wherever the span stands."""
    _, inv = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts])


def rolling(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``length`` consecutive values of ``h``.

    Runs are built by doubling: the hash of 2k values is hash(k)*base^k + hash(next k).
    """
    if len(h) < length:
        return np.zeros(0, np.uint64)
    out, done, part, size = None, 0, h, 1
    left = length
    while left:
        if left & 1:
            if out is None:
                out, done = part, size
            else:
                n = len(h) - done - size + 1
                out = out[:n] * np.uint64(pow(base, size, 1 << 64)) + part[done:done + n]
                done += size
        left >>= 1
        if left:
            n = len(part) - size
            part = part[:n] * np.uint64(pow(base, size, 1 << 64)) + part[size:size + n]
            size *= 2
    return out


def planes(x: np.ndarray) -> bytes:
    """Byte planes of an integer array: small numbers leave runs of zeros that shuffles compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


class KeyTable:
    """Sorted 64-bit keys with the first rank of every leading-bits bucket, so a lookup compares
    one or two keys where a binary search would compare twenty."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(np.unique(keys), np.uint64(2 ** 64 - 1))
        self.size = len(self.keys) - 1
        bits = min(24, max(8, int(self.size * 4).bit_length()))
        self.shift = np.uint64(64 - bits)
        top = (self.keys[:-1] >> self.shift).astype(np.int64)
        count = np.bincount(top, minlength=1 << bits)
        self.start = np.append(0, np.cumsum(count)).astype(np.int32)
        self.most = int(count.max()) if self.size else 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are keys, in order, and which key (rank in sorted order)."""
        if not self.size or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = (h >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        found, ranks = [], []
        for _ in range(self.most):
            hit = self.keys[at] == h
            found.append(todo[hit])
            ranks.append(at[hit])
            at = at + 1
            on = np.flatnonzero(~hit & (at < end))
            if not len(on):
                break
            todo, at, end, h = todo[on], at[on], end[on], h[on]
        found, ranks = np.concatenate(found), np.concatenate(ranks).astype(np.int64)
        order = np.argsort(found, kind="stable") if len(found) and self.most > 1 else slice(None)
        return found[order], ranks[order]


def _stars(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (u long, v long): rows (node, component),
    component being the smallest node reachable; nodes without an edge are not returned.

    Alternating large-star and small-star steps (each a grouped minimum and a join), the
    edge table written to the shared checkpoint folder after each round until it stops
    changing.  Nothing but its count and checksum reaches the driver.
    """
    u, v = F.col("u"), F.col("v")
    e = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    e, last = cut(e), None
    for _ in range(max_rounds):
        state = _stars(e)
        if state == last or not state[0]:
            break
        last = state
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        # the minima are written before they are joined: a join of two shuffles can split a node of many links
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), u).alias("m")))
        big = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        big = cut(big)
        low = cut(big.groupBy("u").agg(F.min("v").alias("m")))
        small = big.join(low, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u != v).distinct()
        e = cut(small)
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    low = e.groupBy("u").agg(F.min("v").alias("component")).select(u.alias("node"), "component")
    roots = e.select(v.alias("node")).distinct().select("node", F.col("node").alias("component"))
    return low.unionByName(roots)
