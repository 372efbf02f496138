"""SimHash near-dedup with pigeonring filtering.

Fingerprints: per document the majority of each bit over the XXH64 values of its word
shingles.  Documents with equal fingerprints form one class before anything is compared.

Candidates: the 64 bits are a ring of 8 segments of 8 bits.  If two fingerprints differ in at
most 2 bits, there is a start on the ring from which every chain of l consecutive segments
differs in at most l * 2 / 8 bits: nothing in 3 segments, at most 1 bit in 7.  One of the
pairs (4th, 5th) and (6th, 7th) segment is therefore equal too.  So a class is looked up under
16 keys (8 starts, 2 pairs) of 40 equal bits; the chains of its key's start, from 1 to 7 segments,
prune the candidates, and only what they leave meets the full Hamming check.  A pair is linked
under the first key that finds it.

A key shared by more than ``HOT`` classes is not joined with itself.  Its classes differ only
in the key's 24 free bits; each class lists its own value and those with one bit flipped, and
classes that list the same value are exactly those 2 or fewer bits apart (their distance is at
most 2 through that value, and two values 2 bits apart have one in between).  Linking each
list entry to its smallest class keeps all connections with 25 rows a class, not all pairs.

Defined cases: null or empty texts (no words) have fingerprint zero and are linked like any
other; fewer words than a shingle give one shingle; rows without doc_id get a fingerprint and
their class's component, but are never its smallest doc_id (a class of such rows alone has
component null); repeated rows stay repeated; rows that share a doc_id with different texts are
linked by their own fingerprints; extra columns are not looked at by ``link``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, ship

SEGMENTS = 8
WIDTH = 64 // SEGMENTS
HOT = 64
UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text."""
    words = text.translate(UPPER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(words))
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    for a in range(0, n, SLICE):
        b = min(n, a + SLICE)
        h = np.fromiter((digest(joined[s:e], seed) for s, e in
                         zip(starts[a:b].tolist(), ends[a + k - 1:b + k - 1].tolist(), strict=True)), np.uint64, b - a)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row, fp): row is a hash of the text, fp the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fp = [fingerprint(t.as_py() or b"", shingle, seed) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fp, np.uint64).view(np.int64))],
                                             schema=schema)

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_hash(F.col(text)).alias("row"),
                    F.col(text).cast("string").alias("text"))
    return ship(d).mapInArrow(run, "doc_id long, row long, fp long")


def row_hash(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def ring_mask(start: int, length: int) -> int:
    return sum(((1 << WIDTH) - 1) << (WIDTH * ((start + k) % SEGMENTS)) for k in range(length))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def key_masks(bits: int) -> list[tuple[int, int]]:
    """(start, mask) of every key: the chain that must be equal, and one equal part of the chain that
    may hold one bit less than ``bits``."""
    clean = (SEGMENTS - 1) // bits if bits else SEGMENTS     # longest chain of budget 0
    if bits != 2:
        return [(i, ring_mask(i, max(1, clean))) for i in range(SEGMENTS)]
    return [(i, ring_mask(i, clean) | ring_mask(i + clean + 2 * half, 2)) for i in range(SEGMENTS) for half in (0, 1)]


def ring_ok(x, start: int, bits: int, longest: int = SEGMENTS):
    """Every chain from ``start`` stays within its share of ``bits``; x is the XOR of two fingerprints."""
    ok = F.lit(True)
    for length in range(1, longest + 1):
        ok = ok & (F.bit_count(x.bitwiseAND(F.lit(signed(ring_mask(start, length))))) <= length * bits // SEGMENTS)
    return ok


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs a, b of key rows (rep, fp, t, key) with an equal key."""
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key"))
                  & (F.col("a.rep") < F.col("b.rep")))


def chained(pairs: DataFrame, bits: int) -> DataFrame:
    """The pairs whose chains from their key's start, all but the whole ring, stay within their budgets."""
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    ok = F.lit(False)
    for k, (s, _) in reversed(list(enumerate(key_masks(bits)))):
        ok = F.when(F.col("a.t") == k, ring_ok(x, s, bits, SEGMENTS - 1)).otherwise(ok)
    return pairs.where(ok)


def key_rows(classes: DataFrame, bits: int) -> DataFrame:
    """(rep, fp, t, key): each class under each of its keys."""
    keys = F.array(*[F.struct(F.lit(k).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                     for k, (_, m) in enumerate(key_masks(bits))])
    return classes.select("rep", "fp", F.explode(keys).alias("x")).select("rep", "fp", "x.t", "x.key")


def links(classes: DataFrame, bits: int = 2) -> DataFrame:
    """Links (u, v) among classes (rep, fp) that connect the classes ``bits`` or fewer bits apart."""
    if bits not in range(0, SEGMENTS, 2):
        raise ValueError(f"the distance must be an even number below {SEGMENTS}")
    masks = key_masks(bits)
    rows = key_rows(classes, bits)
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # only keys that two classes share; their sizes are written first, so a hot key of the join can be split
    rows = cut(rows.join(cut(sizes), ["t", "key"]))
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.coalesce(*[F.when((x.bitwiseAND(F.lit(signed(m))) == 0) & ring_ok(x, s, bits), F.lit(k))
                         for k, (s, m) in enumerate(masks)])
    pairs = chained(candidates(rows.where(F.col("n") <= HOT).drop("n")), bits)
    pairs = pairs.where((F.bit_count(x) <= bits) & (first == F.col("a.t"))) \
        .select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
    hot = rows.where(F.col("n") > HOT)
    flips = hot_links(hot, masks, bits)
    return pairs.unionByName(flips)


def hot_links(hot: DataFrame, masks: list, bits: int) -> DataFrame:
    """Links among the classes of keys that many share, through values near them; see the module's text."""
    from itertools import combinations

    free = [[k for k in range(64) if not m >> k & 1] for _, m in masks]
    near = [[signed(sum(1 << k for k in c)) for r in range(bits // 2 + 1) for c in combinations(f, r)] for f in free]
    tables = F.array(*[F.array(*[F.lit(x) for x in n]) for n in near])
    listed = hot.select("rep", "t", "key", F.col("fp"), F.explode(tables[F.col("t")]).alias("flip")) \
        .select("rep", "t", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    low = listed.groupBy("t", "at").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return listed.join(low, ["t", "at"]).where(F.col("rep") != F.col("v")) \
        .select(F.col("rep").alias("u"), "v").distinct()


def link(docs: DataFrame, shingle: int = 3, bits: int = 2, seed: int = 42, text: str = "text",
         doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row: component_id is the smallest doc_id
    reachable over links of ``bits`` or fewer differing bits."""
    return linked_rows(docs, shingle, bits, seed, text, doc_id).drop("row")


def linked_rows(docs: DataFrame, shingle: int, bits: int, seed: int = 42, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """``link`` with the text's hash as ``row``.  Nodes are fingerprints, as a doc_id may have several."""
    fps = cut(fingerprints(docs, shingle, seed, text, doc_id))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where(F.col("rep").isNotNull()))
    comp = components(links(classes.select(F.col("fp").alias("rep"), "fp"), bits)).withColumnsRenamed(
        {"node": "fp", "component": "root"})
    named = cut(classes.join(comp, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    low = cut(named.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = named.join(low, "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select(
        "doc_id", "row", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = 3, bits: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows and columns of ``docs`` whose doc_id is the smallest of their own text's component; equal
    rows of that doc_id all stay, as do rows without doc_id.  A row is known by doc_id and its text's hash."""
    dup = linked_rows(docs, shingle, bits, text=text, doc_id=doc_id).where(F.col("doc_id") != F.col("component_id")) \
        .select(F.col("doc_id").alias("_dup_id"), F.col("row").alias("_dup_row")).distinct()
    return docs.join(dup, (docs[doc_id].cast("long") == F.col("_dup_id"))
                     & (row_hash(docs[text]) == F.col("_dup_row")), "left_anti")
