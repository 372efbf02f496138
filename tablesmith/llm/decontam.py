"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams scans the documents.

The n-grams of the benchmark are counted first.  They are broadcast in blocks of whole items,
each of at most ``BLOCK_NGRAMS`` n-grams (about 100 bytes each with the words kept for the
exact check), and every block scans all documents once; the hits of the blocks are joined by
document.  So a broadcast never grows with either table.

Words are runs of letters and digits after A-Z are lower-cased (any byte of a non-ASCII
character counts as part of a word).  An item of fewer than ``n`` words, but not none, is one
window.  A hash hit counts only if the words themselves agree.

Defined cases: null texts have no words; items without words or item_id are never found; an
empty benchmark leaves every document clean; repeated rows of an item_id count as one item
with the windows of all its rows; extra columns are passed through by ``decontaminate`` and
not looked at by ``scan``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (WINDOW_BASE, KeyTable, pieces, prefix_hash, rolling, ship, span_hash, text_view, word_spans)

BLOCK_NGRAMS = 500_000
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
HITS = "doc_id long, n_words long, spans array<struct<s:int,e:int>>, items array<string>, row long"


def item_windows(n: int):
    """mapInArrow function: (item_id string, text) to one row per item, its windows as word lists."""
    schema = pa.schema([("item_id", pa.string()), ("n_windows", pa.int64()), ("text", pa.binary())])

    def run(batches):
        for batch in batches:
            data, offs = text_view(batch.column(1))
            ids, sizes, texts = [], [], []
            for k, item in enumerate(batch.column(0).to_pylist()):
                part = LOWER[data[offs[k]:offs[k + 1]]]
                ws, we, _ = word_spans(part, np.array([0, len(part)]), WORD)
                if len(ws):
                    ids.append(item)
                    sizes.append(max(1, len(ws) - n + 1))
                    texts.append(b" ".join(part[a:b].tobytes() for a, b in zip(ws, we, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sizes, pa.int64()),
                                              pa.array(texts, pa.binary())], schema=schema)

    return run


def item_blocks(benchmark: DataFrame, n: int, text: str, item_id: str):
    """The benchmark's items in blocks of at most ``BLOCK_NGRAMS`` windows: lists of (item_id, words)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")) \
        .where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    rows = ship(items).mapInArrow(item_windows(n), "item_id string, n_windows long, text binary")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + r.n_windows > BLOCK_NGRAMS:
            yield block
            block, size = [], 0
        block.append((r.item_id, bytes(r.text).split(b" ")))
        size += r.n_windows
    yield block


class Windows:
    """One block's windows, by length: sorted hashes, and for each hash the items and exact words."""

    def __init__(self, block: list, n: int):
        found: dict[int, dict] = defaultdict(lambda: defaultdict(set))
        for item, words in block:
            k = min(n, len(words))
            for s in range(len(words) - k + 1):
                found[k][b" ".join(words[s:s + k])].add(item)
        self.by_length = {}
        for k, windows in found.items():
            texts = list(windows)
            joined = np.frombuffer(b" ".join(texts), np.uint8)
            ws, we, _ = word_spans(joined, np.array([0, len(joined)]), WORD)
            h = rolling(span_hash(prefix_hash(joined), ws, we), k, WINDOW_BASE)[::k]
            by_hash = defaultdict(list)
            for x, t in zip(h.tolist(), texts, strict=True):
                by_hash[x].append((t, sorted(windows[t])))
            table = KeyTable(np.fromiter(by_hash, np.uint64, len(by_hash)))
            self.by_length[k] = (table, [by_hash[x] for x in table.keys[:-1].tolist()])


def scan_block(windows) -> callable:
    """mapInArrow function: (doc_id, text, row) to HITS rows, one per document."""
    span = pa.struct([("s", pa.int32()), ("e", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)),
                        ("items", pa.list_(pa.string())), ("row", pa.int64())])

    def run(batches):
        by_length = windows.value.by_length
        for batch in batches:
            data, offs = text_view(batch.column(1))
            n_words = np.zeros(batch.num_rows, np.int64)
            spans, items = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for i, j in pieces(offs):
                part = LOWER[data[offs[i]:offs[j]]]
                ws, we, first = word_spans(part, offs[i:j + 1], WORD)
                n_words[i:j] = np.diff(first)
                if not len(ws):
                    continue
                words = span_hash(prefix_hash(part), ws, we)
                row = np.repeat(np.arange(j - i), np.diff(first))
                for k, (table, exact) in by_length.items():
                    at, rank = table.find(rolling(words, k, WINDOW_BASE))
                    ok = row[at] == row[at + k - 1]
                    for s, x in zip(at[ok].tolist(), rank[ok].tolist(), strict=True):
                        text = b" ".join(part[a:b].tobytes() for a, b in zip(ws[s:s + k], we[s:s + k], strict=True))
                        for t, names in exact[x]:
                            if t == text:
                                r = int(row[s])
                                spans[i + r].append((s - int(first[r]), s - int(first[r]) + k))
                                items[i + r].update(names)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_words), pa.array([[{"s": a, "e": b} for a, b in merged(x)] for x in spans],
                                                             pa.list_(span)),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())), batch.column(2)], schema=schema)

    return run


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", doc_id: str = "doc_id",
         item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted strings), items_sha256, contaminated,
    spans (word intervals covered by benchmark windows)."""
    return scan_rows(docs, benchmark, n, text, doc_id, item_text, item_id).drop("row")


def scan_rows(docs: DataFrame, benchmark: DataFrame, n: int, text: str, doc_id: str, item_text: str = "text",
              item_id: str = "item_id") -> DataFrame:
    """``scan`` with the text's hash as ``row``."""
    out = None
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                    F.xxhash64(F.col(text)).alias("row"))
    sc = docs.sparkSession.sparkContext
    for block in item_blocks(benchmark, n, item_text, item_id):
        hits = ship(d).mapInArrow(scan_block(sc.broadcast(Windows(block, n))), HITS)
        out = hits if out is None else out.unionByName(hits.where(F.size("items") > 0))
        several = out is not hits
    if several:  # a document's hits in all blocks; equal rows of a doc_id have equal hits
        first = out.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"),
                                                 F.flatten(F.collect_set("spans")).alias("spans"),
                                                 F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        out = d.select("doc_id", "row").join(first.withColumnsRenamed({"doc_id": "d", "row": "r"}),
                                             F.col("doc_id").eqNullSafe(F.col("d")) & F.col("row").eqNullSafe(F.col("r")))
        out = out.withColumn("spans", F.array_sort("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"),
                              F.greatest(a["to"], x["e"]).alias("to")))["n"]
    items = F.array_sort("items")
    return out.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
                      (covered > 0).alias("contaminated"), items.alias("items"), "spans", "row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_hit_share: float = 0.0,
                  text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows and columns of ``docs`` without contamination: a document of which more than
    ``max_hit_share`` of the words are hit goes; of another with hits, the bytes from the first
    to the last hit word of each span go.  With the default every contaminated document goes.  A row is known
    by doc_id, null or not, and the hash of its text."""
    found = scan_rows(docs, benchmark, n, text, doc_id).where("contaminated") \
        .select(F.col("doc_id").alias("_hit_id"), F.col("row").alias("_hit_row"),
                (F.col("n_hit") / F.col("n_words")).alias("_share"), F.col("spans").alias("_spans")) \
        .dropDuplicates(["_hit_id", "_hit_row"])
    joined = docs.join(found, F.col(doc_id).cast("long").eqNullSafe(F.col("_hit_id"))
                       & (F.xxhash64(F.col(text)) == F.col("_hit_row")), "left")
    kept = joined.where(F.col("_share").isNull() | (F.col("_share") <= max_hit_share))
    if max_hit_share <= 0:
        return kept.select(*[docs[c] for c in docs.columns])

    def clean(t, spans):
        if t is None or not spans:
            return t
        data = np.frombuffer(t.encode(), np.uint8)
        ws, we, _ = word_spans(LOWER[data], np.array([0, len(data)]), WORD)
        out, at = [], 0
        for a, b in merged((x["s"], x["e"]) for x in spans):
            out.append(data[at:ws[a]].tobytes())
            at = int(we[b - 1])
        return b"".join([*out, data[at:].tobytes()]).decode()

    ship(docs)
    text_of = F.udf(clean, "string", useArrow=True)
    return kept.select(*[text_of(F.col(text), F.col("_spans")).alias(c) if c == text else docs[c] for c in docs.columns])
