"""Periodic run detection by the branching-tandem test over an enhanced suffix array.

All documents of a piece get one suffix array over words: a word's number holds its document, so
suffixes of different documents share nothing.  LCP values come from the words themselves for
short matches and from prefix hashes by binary search beyond them.  The values are the nodes of a
binary tree that is never built: position p splits its LCP interval into the part before and the
part from p on.  For each, every suffix i of the smaller part looks up ISA[i + depth] and
ISA[i - depth]: where one lies in the other part, two copies of ``depth`` words stand side by side
and differ in the word after each, a square that branches.  Smaller parts sum up to n log n
suffixes.  Squares are rotated to the left as long as the words agree; what comes out with equal
start and end is one run, whose least period counts.

Defined cases: null, empty and blank texts have no words and no runs; words are compared byte for
byte; repeated rows get equal results, rows without doc_id too; extra columns are not looked at;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, pieces, prefix_hash, ship, span_hash, text_view, word_spans

SHORT = 8           # matches of up to so many words are compared word by word
PART = 1 << 20      # suffixes of smaller parts looked at together
PIECE = 2 << 20     # bytes of text in one suffix array; a longer text has one of its own
RUN = "array<struct<start:long,length:long,period:long>>"


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words have equal numbers."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    joined = data[np.cumsum(inside[:-1]).astype(bool)]
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) by prefix doubling: only suffixes that still share their rank are sorted again."""
    n = len(s)
    order = np.argsort(s)
    sorted_ = s[order]
    head = np.append(True, sorted_[1:] != sorted_[:-1])
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))      # a group's first place is its rank
    rank = np.empty(n, np.int64)
    rank[order] = start
    open_ = ~(head & np.append(head[1:], True))
    todo, k = np.flatnonzero(open_), 1                                  # places whose groups hold more than one suffix
    while len(todo):
        suffix = order[todo]
        after = suffix + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[suffix]
        by = np.argsort(group * (n + 1) + second)                       # groups stay at their places
        suffix, group, second = suffix[by], group[by], second[by]
        order[todo] = suffix
        head = np.append(True, (group[1:] != group[:-1]) | (second[1:] != second[:-1]))
        place = np.maximum.accumulate(np.where(head, todo, 0))
        rank[suffix] = place
        todo = todo[~(head & np.append(head[1:], True))]
        k *= 2
    return order, rank


def match_lengths(s: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from a and b on are equal, ``most`` at most."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    for k in range(SHORT):
        live = live[s[a[live] + k] == s[b[live] + k]]
        out[live] = k + 1
        live = live[most[live] > k + 1]
        if not len(live):
            return out
    low, high = out[live], most[live]
    x, y = a[live], b[live]
    while True:
        on = np.flatnonzero(low < high)
        if not len(on):
            break
        mid = (low[on] + high[on] + 1) >> 1
        same = span_hash(prefix, x[on], x[on] + mid) == span_hash(prefix, y[on], y[on] + mid)
        low[on] = np.where(same, mid, low[on])
        high[on] = np.where(same, high[on], mid - 1)
    out[live] = low
    return out


def splits(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place its interval: the last place before with a smaller value, the next with none greater."""
    n = len(lcp)
    left, right, stack, values = [0] * n, [n] * n, [], lcp.tolist()
    for p, x in enumerate(values):
        while stack and values[stack[-1]] >= x:
            right[stack.pop()] = p
        left[p] = stack[-1] if stack else 0
        stack.append(p)
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares whose next word differs from the one a period before."""
    n = len(sa)
    left, right = splits(lcp)
    node = np.flatnonzero(lcp > 0)
    before = node - left[node] <= right[node] - node
    lo, hi = np.where(before, left[node], node), np.where(before, node, right[node])
    other_lo, other_hi = np.where(before, node, left[node]), np.where(before, right[node], node)
    size, depth = hi - lo, lcp[node]
    starts, periods = [], []
    ends = np.append(0, np.cumsum(size))
    i = 0
    while i < len(node):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PART, "right")) - 1)
        own = np.repeat(np.arange(i, j), size[i:j])
        suffix = sa[np.arange(ends[i], ends[j]) - ends[own] + lo[own]]
        d = depth[own]
        for at, first in ((suffix + d, suffix), (suffix - d, suffix - d)):
            place = isa[np.clip(at, 0, n - 1)]
            hit = (at >= 0) & (at < n) & (place >= other_lo[own]) & (place < other_hi[own])
            starts.append(first[hit])
            periods.append(d[hit])
        i = j
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(words: np.ndarray, first: np.ndarray, least: int = 12):
    """(document, start, length, period) of all runs of at least ``least`` words, by document, start and
    period.  ``words``: word numbers of all documents; first[k]:first[k + 1] are those of document k."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s = doc * (int(words.max()) + 1) + words
    sa, isa = suffix_array(s)
    prefix = prefix_hash(s)
    end = first[1:][doc]
    a, b = sa[:-1], sa[1:]
    most = np.where(doc[a] == doc[b], np.minimum(end[a] - a, end[b] - b), 0)
    lcp = np.append(0, match_lengths(s, prefix, a, b, most))
    start, period = branching_squares(sa, isa, lcp)
    stop = start + 2 * period
    _, one = np.unique(stop * (n + 1) + period, return_index=True)
    start, period, stop = start[one], period[one], stop[one]
    # rotate to the left: words before the square and before its second half, read backwards
    room = start - first[doc[start]]
    back = s[::-1]
    moved = match_lengths(back, prefix_hash(back), n - start, n - start - period, room) if len(start) else none
    start = start - moved
    length = stop - start
    keep = np.flatnonzero(length >= least)
    if not len(keep):
        return none, none, none, none
    keep = keep[np.lexsort((period[keep], length[keep], start[keep]))]
    same = np.append(False, (start[keep][1:] == start[keep][:-1]) & (length[keep][1:] == length[keep][:-1]))
    keep = keep[~same]                                  # multiples of a run's period give the same stretch
    keep = keep[np.lexsort((period[keep], start[keep]))]
    d = doc[start[keep]]
    return d, start[keep] - first[d], length[keep], period[keep]


def collapsed_words(first: np.ndarray, n: int, doc, start, length, period) -> np.ndarray:
    """Which words stay: those in no run, or in its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, first[doc] + start + period, 1)
    np.add.at(depth, first[doc] + start + length, -1)
    return np.cumsum(depth[:-1]) == 0


def texts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, first: np.ndarray):
    """The kept words of each document joined by one space: (bytes, offsets)."""
    size = np.where(keep, ends - starts + 1, 0)         # with a space behind
    total = np.append(0, np.cumsum(size))
    kept = np.flatnonzero(keep)
    n = size[kept] - 1
    out = np.full(int(total[-1]), 32, np.uint8)
    before = np.cumsum(n) - n
    at = np.arange(int(n.sum()))
    out[at + np.repeat(total[kept] - before, n)] = data[at + np.repeat(starts[kept] - before, n)]
    bounds = total[first]
    hole = bounds[1:][np.diff(bounds) > 0] - 1          # the space behind a document's last word
    cuts = np.append(0, np.cumsum(np.diff(bounds) - (np.diff(bounds) > 0)))
    return np.delete(out, hole), cuts


def find_runs(docs: DataFrame, least: int = 12, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row.  ``runs``: (start, length, period) in words of all
    maximal stretches with a least period of at most half their length and ``least`` words at least, by
    start, then period; ``collapsed``: the text's words, those of a run after its first period left out."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            data, offs = text_view(b.column(1))
            for i, j in pieces(offs, PIECE):
                part = data[offs[i]:offs[j]]
                starts, ends, first = word_spans(part, offs[i:j + 1], ~SPACES)
                words = word_numbers(part, starts, ends)
                doc, start, length, period = runs_of(words, first, least)
                keep = collapsed_words(first, len(words), doc, start, length, period)
                out, cuts = texts_of(part, starts, ends, keep, first)
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)],
                                               ["start", "length", "period"]))
                kept = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(first), pa.int64()), runs, kept.cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])

    return ship(d).mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")
