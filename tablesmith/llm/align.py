"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Documents are shuffled by their full text, and each distinct text is tokenised and aligned once,
with the number of its copies as weight.  Token ends are marks on the text's bytes: bytes where
both tokenizers end cut the text into groups, and every stretch between two marks is one link, a
pair of occurrences whose byte ranges overlap.  A task aligns the distinct units (see ``tokens``)
of a block of texts; both tokenizers end at a unit's end, so groups and links of a text are those
of its units in a row.

Pair counts are a grouped sum over the blocks' own tables of distinct pairs.  The sums go back to
the blocks by a join on the pair, in which adaptive execution can split a common pair, and each
block measures its texts.  Measures reach the documents by a join on the text's SHA-256, in which
the documents of a hot text can be split.  A block holds about 6 MB of text whatever the corpus
holds; nothing of it passes the driver.

Defined cases: null and empty texts, and texts that the tokenizers do not give back byte for byte
(a literal U+2581, for instance), have no tokens, zeros everywhere and '' as digest; copies of a
text get equal measures, rows without doc_id too; extra columns are not looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, from_planes, planes, ship
from .tokens import Units, blocks, calls, encode_units, encoder, public_path, ragged, sums, units_of, utf8

#: tokens a and b of one group each: the links of a group are the stretches between token ends
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
ALIGNED = ("block long, key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "units binary, links binary, ends binary, pairs array<struct<a:int,b:int,n:long>>")
#: text of a block: its units, links and pairs are held at once
BLOCK_BYTES = 6 << 20
#: distinct text whose marks are held at once
SLICE_BYTES = 1 << 19
SCHEMA = pa.schema([("block", pa.int64()), ("key", pa.binary()), *((c, pa.int64()) for c in MEASURES[:4]),
                    ("groups_sha256", pa.string()), ("units", pa.binary()), ("links", pa.binary()), ("ends", pa.binary()),
                    ("pairs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])))])


def spelled(enc, ids: np.ndarray, ends: np.ndarray, want: np.ndarray, want_ends: np.ndarray):
    """(bytes of each token, units whose joined tokens are the unit's bytes)."""
    data, offs = enc.spelling
    size = np.diff(offs)[ids]
    got_ends = np.append(0, np.cumsum(size))[ends]
    same = np.diff(got_ends) == np.diff(want_ends)
    rows = np.flatnonzero(same)
    n = np.diff(want_ends)[rows]
    got = data[ragged(offs[ids], size)]
    differ = got[ragged(got_ends[:-1][rows], n)] != want[ragged(want_ends[:-1][rows], n)]
    same[rows] = sums(differ, np.append(0, np.cumsum(n))) == 0
    return size, same


def digits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids in decimal, one row of bytes each, one byte left for a separator; used bytes of each row)."""
    width = len(str(int(ids.max(initial=0))))
    n = np.ones(len(ids), np.int64)
    out = np.zeros((len(ids), width + 1), np.uint8)
    for k in range(1, width):
        n += ids >= 10 ** k
    for k in range(width):
        here = n > k                    # digit k from the left
        out[here, k] = 48 + ids[here] // 10 ** (n[here] - 1 - k) % 10
    return out, n + 1


class Alignment:
    """Some distinct units of a block, aligned: ids, links and groups by unit."""

    def __init__(self, enc_a, enc_b, units):
        ids_a, end_a = encode_units(enc_a, units)
        ids_b, end_b = encode_units(enc_b, units)
        text = np.frombuffer("".join(units.distinct).encode(), np.uint8)
        at = np.append(0, np.cumsum(units.size))
        size_a, good = spelled(enc_a, ids_a, end_a, text, at)
        size_b, good_b = spelled(enc_b, ids_b, end_b, text, at)
        self.good = good & good_b
        live = np.where(self.good, units.size, 0)
        keep_a, keep_b = np.repeat(self.good, np.diff(end_a)), np.repeat(self.good, np.diff(end_b))
        self.a, size_a = ids_a[keep_a], size_a[keep_a]
        self.b, size_b = ids_b[keep_b], size_b[keep_b]
        self.n_a, self.n_b = np.where(self.good, np.diff(end_a), 0), np.where(self.good, np.diff(end_b), 0)
        self.bytes = np.append(0, np.cumsum(live))
        self._marks(np.cumsum(size_a) - 1, np.cumsum(size_b) - 1)

    def _marks(self, last_a: np.ndarray, last_b: np.ndarray) -> None:
        """last_a, last_b: position of each token's last byte."""
        total = int(self.bytes[-1])
        is_a, is_b = np.zeros(total, bool), np.zeros(total, bool)
        is_a[last_a], is_b[last_b] = True, True
        done_a, done_b = np.cumsum(is_a), np.cumsum(is_b)
        both, any_ = is_a & is_b, np.flatnonzero(is_a | is_b)
        # a stretch up to a mark lies in the token of each kind that ends there or next
        self.link_a = self.a[done_a[any_] - is_a[any_]]
        self.link_b = self.b[done_b[any_] - is_b[any_]]
        self.link_ends = np.searchsorted(any_, self.bytes)
        common = np.flatnonzero(both)
        self.group_ends = np.searchsorted(common, self.bytes)
        self.n_links, self.n_groups = np.diff(self.link_ends), np.diff(self.group_ends)
        self._text(common, last_a, last_b, both, done_a, done_b)

    def _text(self, common, last_a, last_b, both, done_a, done_b) -> None:
        """Each unit's groups as text, every group closed by ';'."""
        before_b = np.append(0, done_b[common])             # tokens b before a group
        until_a = done_a[common]                            # tokens a up to a group's end
        row_a = np.arange(len(self.a)) + before_b[np.searchsorted(common, last_a)]
        row_b = np.arange(len(self.b)) + until_a[np.searchsorted(common, last_b)]
        ids = np.zeros(len(self.a) + len(self.b), np.int64)
        ids[row_a], ids[row_b] = self.a, self.b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[row_a[both[last_a]]], mark[row_b[both[last_b]]] = ord("|"), ord(";")
        table, size = digits(ids)
        table[np.arange(len(ids)), size - 1] = mark
        flat = table[np.arange(table.shape[1]) < size[:, None]].tobytes()
        tokens = np.append(0, np.cumsum(self.n_a + self.n_b))
        cutoff = np.append(0, np.cumsum(size))[tokens].tolist()
        self.groups = [flat[x:y] for x, y in zip(cutoff[:-1], cutoff[1:], strict=True)]


def align_units(enc_a, enc_b, units: Units) -> tuple[dict[str, np.ndarray], list[bytes], np.ndarray]:
    """(measures and ``good`` of each distinct unit, its groups as text, the pairs of all links in a row).

    Marks and digits are numbers for every byte of text, so ``SLICE_BYTES`` of the units are aligned at a time."""
    parts, groups, pairs = [], [], []
    for i, j in calls(units, SLICE_BYTES):
        x = Alignment(enc_a, enc_b, Units(units.distinct[i:j], units.size[i:j], units.which[:0], units.first[:0]))
        parts.append([getattr(x, c) for c in ["good", *MEASURES[:4]]])
        groups += x.groups
        pairs.append(x.link_a.astype(np.int64) << 32 | x.link_b)
    each = [np.concatenate([np.zeros(0, t), *p]) for t, *p in zip([bool, *[np.int64] * 4], *parts)]
    return dict(zip(["good", *MEASURES[:4]], each, strict=True)), groups, np.concatenate([np.zeros(0, np.int64), *pairs])


def align_block(enc_a, enc_b, texts: list[bytes], copies: np.ndarray, digest: bool = True):
    """Rows of one block: its texts, then the block's links and distinct pairs."""
    units = units_of(texts, True, enc_a.safe_cuts and enc_b.safe_cuts)
    x, spelled_groups, pairs = align_units(enc_a, enc_b, units)
    good = (sums(~x["good"][units.which], units.first) == 0) & (np.diff(units.first) > 0)
    first = units.first.tolist()
    rows = []
    total = {c: np.where(good, sums(x[c][units.which], units.first), 0) for c in MEASURES[:4]}
    for k, ok in enumerate(good.tolist()):
        which = units.which[first[k]:first[k + 1]] if ok else units.which[:0]
        groups = b"".join(map(spelled_groups.__getitem__, which.tolist()))[:-1]
        rows.append(((hashlib.sha256(groups).hexdigest() if digest else groups.decode()) if ok else "", planes(which)))
    weight = np.bincount(units.which, np.repeat(np.where(good, copies, 0), np.diff(units.first)),
                         len(units.distinct)).astype(np.int64)
    codes, which = np.unique(pairs, return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, which, np.repeat(weight, x["n_links"]))
    return rows, total, which.astype(np.int32), np.append(0, np.cumsum(x["n_links"])).astype(np.int32), codes, n


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = True,
          text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    Tokenizer A reads a space and the text, tokenizer B (a .model, which adds the space) the text.
    A pair of ids counts as many as the corpus has links of it, copies of texts included; n_best: links
    whose pair has the highest count of all pairs of its B id; count_sum: the links' counts summed.
    ``digest=False`` gives the groups themselves as ``groups`` instead of their SHA-256.
    """
    path_a, path_b = path_a or public_path("byte_bpe_50k.json"), path_b or public_path("piece_bpe_32k.model")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    key = F.unhex(F.sha2(F.col("text"), 256))
    distinct = d.where(F.col("text") != "").groupBy("text").agg(F.count(F.lit(1)).alias("copies")) \
        .select(key.alias("key"), "copies", "text")

    def run(batches):
        enc_a, enc_b = encoder(path_a, True), encoder(path_b)
        block = TaskContext.get().partitionId() << 32
        for b in blocks(batches, BLOCK_BYTES):
            texts = utf8(b.column(2))
            rows, total, links, ends, codes, n = align_block(
                enc_a, enc_b, texts, b.column(1).to_numpy(), digest)
            size = len(rows) + 1
            none = [None] * (size - 1)
            pairs = pa.StructArray.from_arrays([pa.array((codes >> 32).astype(np.int32)), pa.array(codes.astype(np.int32)),
                                                pa.array(n)], ["a", "b", "n"])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(size, block)), pa.array([*b.column(0).to_pylist(), None], pa.binary()),
                *(pa.array(np.append(total[c], 0)) for c in MEASURES[:4]),
                pa.array([*(r[0] for r in rows), None], pa.string()),
                pa.array([*(r[1] for r in rows), None], pa.binary()),
                pa.array([*none, planes(links)], pa.binary()), pa.array([*none, planes(ends)], pa.binary()),
                pa.ListArray.from_arrays(pa.array([*[None] * (size - 1), 0, len(codes)], pa.int32()), pairs)], schema=SCHEMA)
            block += 1

    aligned = cut(ship(distinct).mapInArrow(run, ALIGNED))
    pairs = aligned.where("pairs IS NOT NULL").select("block", F.explode("pairs").alias("p")) \
        .select(F.col("block").alias("home"), "p.a", "p.b", "p.n")
    counts = cut(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")))
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = counts.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    known = pairs.select("home", "a", "b").join(counts, ["a", "b"]).select("home", "a", "b", "n", "best")
    schema = pa.schema([("key", pa.binary()), *((c, pa.int64()) for c in MEASURES), ("groups_sha256", pa.string())])

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.filter(pc.is_null(left["key"]))
        texts = left.filter(pc.is_valid(left["key"]))
        if not texts.num_rows:
            return schema.empty_table()
        links = from_planes(own["links"][0].as_py(), np.int32)
        ends = from_planes(own["ends"][0].as_py(), np.int32)
        # a block numbers its pairs in order of their ids, and every one of them has come back
        order = np.lexsort((right["b"].to_numpy(), right["a"].to_numpy()))
        n, top = right["n"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        n_best, count = sums(top[links], ends), sums(n[links], ends)
        which = [from_planes(x, np.int32) for x in texts["units"].to_pylist()]
        first = np.append(0, np.cumsum([len(x) for x in which]))
        which = np.concatenate(which)
        return pa.table([*(texts[c] for c in ["key", *MEASURES[:4]]), pa.array(sums(n_best[which], first)),
                         pa.array(sums(count[which], first)), texts["groups_sha256"]], schema=schema)

    fields = "key binary, " + ", ".join(f"{c} long" for c in MEASURES) + ", groups_sha256 string"
    measures = aligned.drop("pairs").groupBy("block").cogroup(known.groupBy("home")).applyInArrow(measure, fields)
    out = d.select("doc_id", key.alias("key")).join(measures, "key", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES),
                      F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256" if digest else "groups"))
