"""Language identification by interpolated Kneser-Ney character models.

One model of ``ORDER`` characters per language, learned from all documents with a language:
Spark counts their n-grams, and the driver turns the distinct ones, all of them, into
probabilities.  What it holds and broadcasts grows with the number of distinct sequences of
``ORDER`` letters (16 bytes each while counting, then 8 bytes for every language), not with the
length of the texts, and nothing is left out to keep it small.  All models together are one sorted array of n-gram hashes per order, with a column of log
probabilities and of back-off weights for each language, so one lookup a character scores
every language.  The language of the lowest cross-entropy per character wins.

Rejection is calibrated: a second model of the same counts leaves out a hash-chosen tenth of the
documents; a prediction is ``accepted`` if its cross-entropy is no higher than the ``ACCEPT``
quantile of theirs under that model.  A language that only they have accepts all.  ``score`` is the
winner's posterior with the evidence of at most ``SCORE_CHARS`` characters.

Text is lower-cased, and every run of other characters than letters is one space.  Defined
cases: a null text or one without a letter is ``und`` with score 0, as is every text when
nothing could be learned; equal cross-entropies give the first language in order; a null lang
is never learned; repeated rows get equal results; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, KeyTable, cut, mix, pieces, rolling, ship, text_view

ORDER = 4
ACCEPT = 0.999
SCORE_CHARS = 64
PIECE = 2 << 20
PAD = 32


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of all texts, each after ORDER - 1 pads and before one, and each text's first one."""
    joined = "\0".join([t.replace("\0", " ") for t in texts] + [""]).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = codes == 0
    text = np.cumsum(end) - end
    codes = np.where(letters()[codes], codes, np.uint32(PAD))
    before = np.append(True, (codes[:-1] == PAD) | end[:-1])
    keep = (codes != PAD) | ~before | end         # runs of spaces are one; the end stays as a space
    codes, text = codes[keep], text[keep]
    size = np.bincount(text, minlength=len(texts))
    first = np.append(0, np.cumsum(size + ORDER - 1))
    out = np.full(first[-1], PAD, np.uint32)
    out[np.arange(len(codes)) + (text + 1) * (ORDER - 1)] = codes
    return out, first


def gram_hash(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points up to each position; the first k - 1 entries mean nothing."""
    h = mix(rolling(codes.astype(np.uint64) + np.uint64(k << 32), k, BASE))
    return np.append(np.zeros(min(k - 1, len(codes)), np.uint64), h)


def texts_of(col: pa.Array):
    """The column's texts in pieces of bounded size."""
    _, offs = text_view(col)
    for i, j in pieces(offs, PIECE):
        yield i, j, [t or "" for t in col.slice(i, j - i).to_pylist()]


@dataclass
class Model:
    langs: list[str]
    tables: list[KeyTable]        # of order 1 to ORDER
    logs: list[np.ndarray]        # a row for each key: log probability by language, then back-off weight by language
    unseen: np.ndarray            # log probability of an unknown character by language
    accept: np.ndarray            # highest accepted cross-entropy by language


def kneser_ney(grams: np.ndarray, counts: np.ndarray, alphabet: int):
    """Probabilities and back-off weights of one language from its distinct n-grams (rows of code points).

    Returns per order 1 to ORDER: (k-grams, probability, and for each k-gram as a context its weight)."""
    orders = []
    for k in range(grams.shape[1], 0, -1):
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context, at = np.unique(grams[:, :-1], axis=0, return_inverse=True) if k > 1 else (np.zeros((1, 0), grams.dtype),
                                                                                      np.zeros(len(grams), np.int64))
        at = at.ravel()
        seen = np.bincount(at, counts, len(context))
        kinds = np.bincount(at, minlength=len(context))
        orders.append((grams, np.maximum(counts - discount, 0) / seen[at], context, discount * kinds / seen, at))
        grams, counts = np.unique(grams[:, 1:], axis=0, return_counts=True)   # continuation counts
        counts = counts.astype(np.float64)
    out, lower, shorter = [], np.array([1.0 / alphabet]), None
    for grams, p, context, weight, at in reversed(orders):
        if shorter is None:
            base = np.full(len(grams), lower[0])
        else:
            base = lower[find_rows(shorter, grams[:, 1:])]
        p = p + weight[at] * base
        out.append((grams, p, context, weight))
        lower, shorter = p, grams
    return out


def find_rows(sorted_rows: np.ndarray, rows: np.ndarray) -> np.ndarray:
    kind = np.dtype([("", rows.dtype)] * rows.shape[1])
    a, b = (np.ascontiguousarray(x).view(kind).ravel() for x in (sorted_rows, rows))
    order = np.argsort(a, kind="stable")
    return order[np.searchsorted(a, b, sorter=order)]


def row_hash(rows: np.ndarray) -> np.ndarray:
    k = rows.shape[1]
    h = np.zeros(len(rows), np.uint64)
    for c in rows.T:
        h = h * np.uint64(BASE) + (c.astype(np.uint64) + np.uint64(k << 32))
    return mix(h)


def build(grams_of: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """grams_of: by language its distinct ORDER-grams as code points, and their counts."""
    langs = sorted(grams_of)
    alphabet = len(np.unique(np.concatenate([g.ravel() for g, _ in grams_of.values()]))) + 1 if langs else 1
    models = [kneser_ney(*grams_of[x], alphabet) for x in langs]
    unseen = np.array([np.log(m[0][3][0] / alphabet) for m in models])
    tables, logs = [], []
    for k in range(1, ORDER + 1):
        keys = [row_hash(m[k - 1][0]) for m in models]
        contexts = [row_hash(m[k][2]) for m in models] if k < ORDER else []
        table = KeyTable(np.concatenate([*keys, *contexts]) if langs else np.zeros(0, np.uint64))
        log = np.zeros((table.size, 2 * len(langs)), np.float32)
        rows = np.unique(np.concatenate([m[k - 1][0] for m in models] + [m[k][2] for m in models if k < ORDER]), axis=0) \
            if langs else np.zeros((0, k), np.uint32)
        at = np.searchsorted(table.keys[:-1], row_hash(rows))
        # an n-gram that a language lacks: its context's weight there, and the shorter n-gram's probability
        if k == 1:
            back = np.tile(unseen, (len(rows), 1))
        else:
            short = np.searchsorted(tables[-1].keys[:-1], row_hash(rows[:, 1:]))
            ctx_found, ctx = tables[-1].find(row_hash(rows[:, :-1]))
            back = logs[-1][short, :len(langs)].astype(np.float64)
            back[ctx_found] += logs[-1][ctx, len(langs):]
        log[at, :len(langs)] = back
        for j, m in enumerate(models):
            log[np.searchsorted(table.keys[:-1], keys[j]), j] = np.log(m[k - 1][1])
            if k < ORDER:
                log[np.searchsorted(table.keys[:-1], contexts[j]), len(langs) + j] = np.log(np.maximum(m[k][3], 1e-12))
        tables.append(table)
        logs.append(log)
    return Model(langs, tables, logs, unseen, np.full(len(langs), np.inf))


def cross_entropy(model: Model, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: cross-entropy per character by language (nats), and the number of its letters."""
    n, langs = len(codes), len(model.langs)
    start = np.zeros(n, bool)
    for k in range(ORDER - 1):
        start[first[:-1] + k] = True        # pads are context only
    total = np.zeros((n, langs), np.float32)
    todo = np.flatnonzero(~start)
    for k in range(ORDER, 0, -1):
        table, log = model.tables[k - 1], model.logs[k - 1]
        h = gram_hash(codes, k)
        found, rank = table.find(h[todo])
        total[todo[found]] += log[rank, :langs]
        left = np.ones(len(todo), bool)
        left[found] = False
        todo = todo[left]
        if not len(todo):
            break
        if k > 1:       # the context's weight, where it is known
            h = gram_hash(codes, k - 1)
            found, rank = model.tables[k - 2].find(h[todo - 1])
            total[todo[found]] += model.logs[k - 2][rank, langs:]
        else:
            total[todo] += model.unseen.astype(np.float32)
    sums = np.add.reduceat(total, first[:-1], axis=0, dtype=np.float64) if n else np.zeros((len(first) - 1, langs))
    size = np.maximum(np.diff(first) - (ORDER - 1), 1)
    letters_in = np.add.reduceat((codes != PAD).astype(np.int64), first[:-1]) if n else np.zeros(len(first) - 1, np.int64)
    return -sums / size[:, None], letters_in


def predict(model: Model, texts: list[str]):
    """Arrays (language index or -1, score, cross-entropy, accepted) of some texts."""
    if not texts or not model.langs:
        z = np.zeros(len(texts))
        return z.astype(np.int64) - 1, z, z, z.astype(bool)
    codes, first = characters(texts)
    ce, letters_in = cross_entropy(model, codes, first)
    best = ce.argmin(axis=1)
    low = ce[np.arange(len(ce)), best]
    size = np.minimum(np.diff(first) - (ORDER - 1), SCORE_CHARS)
    score = 1.0 / np.exp(-(ce - low[:, None]) * size[:, None]).sum(axis=1)
    none = letters_in == 0
    return (np.where(none, -1, best), np.where(none, 0.0, score), np.where(none, 0.0, low),
            ~none & (low <= model.accept[best]))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, accepted) for rows (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.string() if docs.schema[0].dataType.typeName() == "string" else pa.int64()),
                        ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()),
                        ("accepted", pa.bool_())])

    def run(batches):
        for b in batches:
            for i, j, texts in texts_of(b.column(1)):
                best, score, low, ok = predict(held.value, texts)
                names = [*held.value.langs, "und"]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([names[k] for k in best], pa.string()),
                                                  pa.array(score), pa.array(low), pa.array(ok)], schema=schema)

    kind = docs.schema[0].dataType.simpleString()
    return ship(docs).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, accepted boolean")


def train(docs: DataFrame, train_rows: Column | None = None, lang: str = "lang", text: str = "text",
          doc_id: str = "doc_id") -> Model:
    """Learn from the documents that meet ``train_rows`` and have a language and a text."""
    d = docs.where(train_rows) if train_rows is not None else docs
    d = d.select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"),
                 F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(1_000_003)).alias("at")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    out_of_fold = F.col("at") % 10 == 0
    schema = pa.schema([("lang", pa.string()), ("out", pa.bool_()), ("gram", pa.binary()), ("n", pa.int64())])

    def count(batches):
        for b in batches:
            kinds = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
            for i, j, texts in texts_of(b.column(1)):
                for x, out in sorted(set(kinds[i:j])):
                    codes, first = characters([t for t, y in zip(texts, kinds[i:j], strict=True) if y == (x, out)])
                    start = np.zeros(len(codes), bool)
                    for k in range(ORDER - 1):
                        start[first[:-1] + k] = True
                    at = np.flatnonzero(~start)
                    _, one, n = np.unique(gram_hash(codes, ORDER)[at], return_index=True, return_counts=True)
                    grams = codes[at[one][:, None] + np.arange(1 - ORDER, 1)]
                    names = [r.tobytes() for r in grams]
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(names), pa.string()), pa.array([out] * len(names), pa.bool_()),
                                                      pa.array(names, pa.binary()), pa.array(n)], schema=schema)

    learned = ship(d).select("lang", "text", out_of_fold.alias("out")).mapInArrow(count, "lang string, out boolean, gram binary, n long")
    counted = cut(learned.groupBy("lang", "gram").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~F.col("out"), F.col("n"))), F.lit(0)).alias("fold")))

    def learn(n: str) -> Model:
        kept = counted.where(F.col(n) > 0).select("lang", "gram", F.col(n).alias("n"))
        table = kept.orderBy("lang", "gram").toArrow().combine_chunks()
        codes = np.concatenate([np.frombuffer(x.buffers()[2], np.uint32).reshape(-1, ORDER)[:len(x) + x.offset][x.offset:]
                                for x in table["gram"].chunks if len(x)] or [np.zeros((0, ORDER), np.uint32)])
        langs = table["lang"].combine_chunks().dictionary_encode()
        which, counts = langs.indices.to_numpy(), table["n"].to_numpy().astype(np.float64)
        return build({x: (codes[which == k], counts[which == k]) for k, x in enumerate(langs.dictionary.to_pylist())})

    checked = _scored(d.where(out_of_fold).select(F.col("lang").alias("doc_id"), "text"), learn("fold")) \
        .where("doc_id = lang_pred").groupBy("lang_pred") \
        .agg(F.percentile_approx("cross_entropy", ACCEPT, 10_000).alias("high")).collect()
    model = learn("n")
    for r in checked:
        model.accept[model.langs.index(r.lang_pred)] = r.high
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, accepted) for every row."""
    return _scored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), model)
