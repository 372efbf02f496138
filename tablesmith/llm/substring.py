"""Substring dedup: repeated fixed-length word windows are removed but for their first occurrence.

1. Every task hashes each window of ``length`` consecutive words (Rabin-Karp over word
   hashes) and deals the hashes to buckets by a second, independent hash.  A shuffled row
   is one bucket's share of some thousand documents: hashes, documents and starts as packed
   arrays, about 10 bytes a window instead of a row for each.
2. Each bucket (about ``BUCKET_WINDOWS`` windows, whatever the corpus holds) counts its
   hashes.  Of a hash that occurs more than once, all occurrences but the first by
   (doc_id, start) are marked.  A flush of about ``FLUSH_WINDOWS`` windows has done so for
   itself before: a bucket gets a hash once from each flush, however often it occurs.
   From ``FAN`` buckets on (about 25 GB of text) buckets are dealt in two rounds: rows of the
   first hold a group of buckets each, and tasks that read such groups in streams deal them out, so a
   row has about ``FLUSH_WINDOWS / FAN`` windows or more, up to ``FAN`` squared buckets (100 TB).
3. Marks are dealt in the same rounds, regrouped by the document's hash and merged into maximal word intervals, and the
   documents join their intervals.

Two different windows are taken for one only if 64 bits of hash and the bucket agree: with n
windows that happens n * BUCKET_WINDOWS / 2^65 times (0.5 for the 10^13 windows of 100 TB).

A document is a doc_id and a text.  Where a doc_id has several texts, the text's hash is its tag
and orders them; the tag of all others is 0 and costs nothing.

Defined cases: a null text has no words; a row without doc_id is neither compared nor
changed; repeated rows of one doc_id and text get the same result, different texts of one doc_id
are compared like any others; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (ROUTE_BASE, SPACES, WINDOW_BASE, cut, from_planes, mix, pieces, planes, prefix_hash, rolling,
                     ship, span_hash, text_view, word_spans)

BUCKET_WINDOWS = 1 << 20
FLUSH_WINDOWS = 1 << 20
FAN = 1 << 12           # shuffled rows that a flush makes at most
SHARE = "bucket int, ids binary, tags binary, counts binary, gaps binary, hashes binary, subs binary"
MARKS = "part int, ids binary, tags binary, counts binary, starts binary"
SPANS = "doc_id long, tag long, spans binary"


def window_count(docs: DataFrame, text: str = "text") -> int:
    """An upper estimate of the number of windows: a word and its space take two bytes or more,
    about six on average; only bucket sizes depend on it."""
    n = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0]
    return int(n or 0) // 6 + 1


def packed_tags(tags: np.ndarray) -> bytes:
    return planes(tags) if tags.any() else b""


def unpacked_tags(b: bytes, n: int) -> np.ndarray:
    return from_planes(b, np.int64) if b else np.zeros(n, np.int64)


def repeats(h: np.ndarray, route: np.ndarray, ids: np.ndarray, tags: np.ndarray,
            starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows that share hash and route: the positions of all but the first by (id, tag, start), and of
    those that stand at the first one's very place (repeated rows)."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    at = order[many]
    at = at[np.lexsort((starts[at], tags[at], ids[at], route[at], h[at]))]
    if not len(at):
        return at, at
    new = np.append(True, (h[at][1:] != h[at][:-1]) | (route[at][1:] != route[at][:-1]))
    head = np.flatnonzero(new)
    lead = at[np.repeat(head, np.diff(np.append(head, len(at))))]
    gone = (ids[at] != ids[lead]) | (tags[at] != tags[lead]) | (starts[at] != starts[lead])
    return at[gone], at[~gone & ~new]


def packed_marks(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, parts: int, fine: int = 1) -> list[tuple]:
    """MARKS rows of windows to remove; documents are dealt to parts by hash, ``fine`` parts to a row."""
    part = (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64) // fine
    order = np.lexsort((starts, tags, ids, part))
    ids, tags, starts, part = ids[order], tags[order], starts[order], part[order]
    rows = []
    for block in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1) if len(part) else []:
        d, t = ids[block], tags[block]
        first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
        rows.append((int(part[block[0]]), planes(np.diff(d[first], prepend=0)), packed_tags(t[first]),
                     planes(np.diff(np.append(first, len(d))).astype(np.uint32)),
                     planes(starts[block].astype(np.uint32))))
    return rows


def unpacked_marks(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tags, starts) of the windows of MARKS rows, given as (ids, tags, counts, starts)."""
    ids, tags, starts = [], [], []
    for d, t, n, s in rows:
        counts = from_planes(n, np.uint32)
        ids.append(np.repeat(np.cumsum(from_planes(d, np.int64)), counts))
        tags.append(np.repeat(unpacked_tags(t, len(counts)), counts))
        starts.append(from_planes(s, np.uint32).astype(np.int64))
    return tuple(np.concatenate(x) for x in (ids, tags, starts))


SHARE_ARROW = pa.schema([("bucket", pa.int32()),
                         *((c, pa.binary()) for c in ("ids", "tags", "counts", "gaps", "hashes", "subs"))])
MARKS_ARROW = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("ids", "tags", "counts", "starts"))])


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def packed_shares(held: list[tuple], parts: int, fine: int, part_fine: int) -> list[tuple]:
    """SHARE rows of the held windows (hashes, buckets, document numbers, starts, and the documents' ids and tags).
    Only the first window of each hash goes on to its bucket, ``fine`` buckets to a row; the others are repeats already
    and go as MARKS rows (without hashes), ``part_fine`` parts to a row, by way of any of these parts' numbers."""
    hashes, bucket, row, start = (np.concatenate([x[k] for x in held]) for k in range(4))
    ids, tags = (np.concatenate([x[k] for x in held]) for k in (4, 5))
    gone, copies = repeats(hashes, bucket, ids[row], tags[row], start)
    marks = packed_marks(ids[row[gone]], tags[row[gone]], start[gone].astype(np.int64), parts, part_fine)
    by_way = int(mix(hashes[:1])[0] % np.uint64(part_fine))
    out = [(x[0] * part_fine + by_way, *x[1:], None, None) for x in marks]
    left = np.ones(len(hashes), bool)
    left[gone] = left[copies] = False
    order = np.flatnonzero(left)
    order = order[np.argsort(bucket[order] // fine, kind="stable")]
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order] // fine)) + 1):
        rows = row[part]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        starts = start[part].astype(np.int64)
        gaps = np.diff(starts, prepend=0)
        gaps[first] = starts[first]
        out.append((int(bucket[part[0]]) // fine, planes(np.diff(ids[rows[first]], prepend=0)), packed_tags(tags[rows[first]]),
                    planes(np.diff(np.append(first, len(rows))).astype(np.uint32)), planes(gaps.astype(np.uint32)),
                    hashes[part].tobytes(), (bucket[part] % fine).astype(np.uint16).tobytes() if fine > 1 else b""))
    return out


def unpacked_share(ids: bytes, tags: bytes, counts: bytes, gaps: bytes) -> tuple:
    """(document numbers, starts, the documents' ids and tags) of a SHARE row's windows."""
    counts = from_planes(counts, np.uint32).astype(np.int64)
    gaps = from_planes(gaps, np.uint32).astype(np.int64)
    total = np.cumsum(gaps)
    first = np.cumsum(counts) - counts
    return (np.repeat(np.arange(len(counts)), counts), total - np.repeat(total[first] - gaps[first], counts),
            np.cumsum(from_planes(ids, np.int64)), unpacked_tags(tags, len(counts)))


def window_shares(length: int, buckets: int, fine: int = 1):
    """mapInArrow function: (doc_id, tag, text) to SHARE rows."""

    def run(batches):
        held, size, docs = [], 0, 0
        for batch in batches:
            data, offs = text_view(batch.column(2))
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in pieces(offs):
                part = data[offs[i]:offs[j]]
                ws, we, first = word_spans(part, offs[i:j + 1], ~SPACES)
                if len(ws) < length:
                    continue
                words = span_hash(prefix_hash(part), ws, we)
                row = np.repeat(np.arange(j - i), np.diff(first))
                ok = np.flatnonzero(row[:len(row) - length + 1] == row[length - 1:])
                route = rolling(words, length, ROUTE_BASE)[ok] >> np.uint64(33)
                held.append((rolling(words, length, WINDOW_BASE)[ok], (route % np.uint64(buckets)).astype(np.int32),
                             row[ok] + docs, ok - first[row[ok]], ids[i:j].astype(np.int64),
                             tags[i:j].astype(np.int64)))
                size, docs = size + len(ok), docs + j - i
                if size >= FLUSH_WINDOWS:
                    yield arrow_rows(packed_shares(held, buckets, fine, fine), SHARE_ARROW)
                    held, size, docs = [], 0, 0
        if size:
            yield arrow_rows(packed_shares(held, buckets, fine, fine), SHARE_ARROW)

    return run


def split_shares(buckets: int, fine: int):
    """mapInArrow function: SHARE rows of ``fine`` buckets each to SHARE rows of one bucket each.  A flush again keeps
    only the first window of each hash, so a window found in every flush of the first round is thinned out here."""

    def run(batches):
        held, size, docs = [], 0, 0
        for batch in batches:
            done = []
            for b, d, t, n, g, h, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if h is None:
                    done.append((b, d, t, n, g, None, None))
                    continue
                row, start, ids, tags = unpacked_share(d, t, n, g)
                bucket = np.int32(b * fine) + np.frombuffer(s, np.uint16).astype(np.int32)
                held.append((np.frombuffer(h, np.uint64), bucket, row + docs, start, ids, tags))
                size, docs = size + len(row), docs + len(ids)
                if size >= FLUSH_WINDOWS:
                    done += packed_shares(held, buckets, 1, fine)
                    held, size, docs = [], 0, 0
            yield arrow_rows(done, SHARE_ARROW)
        if size:
            yield arrow_rows(packed_shares(held, buckets, 1, fine), SHARE_ARROW)

    return run


def split_marks(parts: int):
    """mapInArrow function: MARKS rows of several parts each to MARKS rows of one part each."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, d, t, n, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                held.append((d, t, n, s))
                size += len(s)
                if size >= FLUSH_WINDOWS:       # starts take a byte each at least
                    yield arrow_rows(packed_marks(*unpacked_marks(held), parts), MARKS_ARROW)
                    held, size = [], 0
        if held:
            yield arrow_rows(packed_marks(*unpacked_marks(held), parts), MARKS_ARROW)

    return run


def mark_repeats(parts: int, fine: int = 1):
    """applyInPandas function: the SHARE rows of one bucket to MARKS rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, ids, tags, starts, rows = [], [], [], [], []
        for r in pdf.itertuples(index=False):
            if r.hashes is None:
                rows.append((r.bucket // fine, r.ids, r.tags, r.counts, r.gaps))
                continue
            row, start, d, t = unpacked_share(r.ids, r.tags, r.counts, r.gaps)
            hashes.append(np.frombuffer(r.hashes, np.uint64))
            ids.append(d[row])
            tags.append(t[row])
            starts.append(start)
        if hashes:
            h, ids, tags, starts = (np.concatenate(x) for x in (hashes, ids, tags, starts))
            gone, _ = repeats(h, np.zeros(len(h), np.int8), ids, tags, starts)
            rows += packed_marks(ids[gone], tags[gone], starts[gone], parts, fine)
        return pd.DataFrame(rows, columns=["part", "ids", "tags", "counts", "starts"])

    return run


def merge_spans(length: int):
    """applyInPandas function: the MARKS rows of one part to a row per document with its maximal
    intervals, (first word, end) pairs of int64."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, tags, starts = unpacked_marks(zip(pdf["ids"], pdf["tags"], pdf["counts"], pdf["starts"], strict=True))
        order = np.lexsort((starts, tags, ids))
        ids, tags, starts = ids[order], tags[order], starts[order]
        other = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
        new = np.append(True, other | (starts[1:] > starts[:-1] + length))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ids)) - 1
        spans = np.stack([starts[first], starts[last] + length], axis=1)
        head = np.flatnonzero(np.append(True, other)[first])
        return pd.DataFrame({"doc_id": ids[first][head], "tag": tags[first][head], "spans": [x.tobytes() for x in np.split(spans, head[1:])]})

    return run


def tagged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, tag, text): the tag is the text's hash where a doc_id has several texts, else 0."""
    row = F.xxhash64(F.coalesce("text", F.lit("")))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    several = cut(d.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
                  .where("lo < hi").select(F.col("doc_id").alias("_several")))
    return d.join(several, F.col("doc_id") == F.col("_several"), "left") \
        .select("doc_id", F.when(F.col("_several").isNotNull(), row).otherwise(F.lit(0)).cast("long").alias("tag"), "text")


def repeated_spans(docs: DataFrame, length: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, tag, spans): for each document with repeated windows the word intervals to remove."""
    return _spans_of(tagged(docs, text, doc_id), length)


def _spans_of(d: DataFrame, length: int) -> DataFrame:
    d = d.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    groups = max(1, -(-window_count(d) // BUCKET_WINDOWS))
    fine = -(-groups // FAN)                # buckets that one row of the first round holds
    groups = -(-groups // fine)
    buckets = groups * fine
    shares = ship(d).mapInArrow(window_shares(length, buckets, fine), SHARE)
    if fine > 1:
        shares = shares.repartition(groups, "bucket").mapInArrow(split_shares(buckets, fine), SHARE)
    marks = shares.groupBy("bucket").applyInPandas(mark_repeats(buckets, fine), MARKS)
    if fine > 1:
        marks = marks.repartition(groups, "part").mapInArrow(split_marks(buckets), MARKS)
    return marks.groupBy("part").applyInPandas(merge_spans(length), SPANS)


def drop_spans(words: list, spans: bytes | None) -> list:
    if not spans:
        return words
    kept, at = [], 0
    for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
        kept += words[at:a]
        at = b
    return kept + words[at:]


def dedup_substrings(docs: DataFrame, length: int = 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_sha256): ``text`` is what is left, words joined by a space."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()),
                        ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def apply(batches):
        for batch in batches:
            out = [[], [], [], []]
            for t, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                words = (t.as_py() or b"").split()
                kept = drop_spans(words, spans.as_py())
                joined = b" ".join(kept)
                for x, y in zip(out, (joined.decode(), len(words), len(words) - len(kept),
                                      hashlib.sha256(joined).hexdigest()), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in
                                                                  zip(out, list(schema)[1:], strict=True))], schema=schema)

    d = tagged(docs, text, doc_id)
    spans = _spans_of(d, length).select(F.col("doc_id").alias("_span_id"), F.col("tag").alias("_span_tag"), "spans")
    d = d.join(spans, (F.col("doc_id") == F.col("_span_id")) & (F.col("tag") == F.col("_span_tag")), "left") \
        .select("doc_id", "text", "spans")
    return ship(d).mapInArrow(apply, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")
