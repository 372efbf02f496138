"""Line dedup with DataFrame functions only.

Lines are exploded with their positions, normalised and hashed to 128 bits; a hash's
documents are counted with map-side aggregation; the lines of keys found in at least
``min_docs`` documents are dropped, except in the smallest doc_id that holds the key; and the
positions left are reassembled into the text.  Lines travel as hashes, so only the documents
themselves are shuffled as text, once, and a line that a third of all documents share is only
a skewed join of small rows, which adaptive execution splits.

A row is known by doc_id and the hash of its text, so of rows that share a doc_id each loses only
its own lines.  A text is split once, however many lines it has.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` code
points never drop; a row without doc_id is neither counted nor changed; rows of one doc_id count
as one document, equal ones get equal results; an empty table gives an empty result; extra
columns are passed through by ``dedup`` and not looked at by ``line_report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once; a column used inside a lambda is computed for every element."""
    return F.transform(F.array(value), body)[0]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def dropped_positions(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, text: str = "text",
                      doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row, dropped): the positions of each row's lines to drop, rows without any left out; row is
    ``row_hash`` of the text."""
    # the hash of the text is computed below the explode: beside it, it would be computed for every line
    rows = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), row_hash(F.col(text)).alias("row"), F.col(text).alias("text"))
    lines = rows.select("doc_id", "row", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keyed = cut(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row", "pos"))
    if min_docs == 2:   # two documents at least: the smallest and the largest doc_id differ
        keys = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    else:
        keys = keyed.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")) \
            .groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.count("one").alias("n")).where(F.col("n") >= min_docs)
    # written, so that both sides of the join are shuffles and adaptive execution can split a very common line
    hits = keyed.join(cut(keys.select("h1", "h2", "lo")), ["h1", "h2"]).where(F.col("doc_id") != F.col("lo"))
    return hits.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("dropped"))


def _with_kept(docs: DataFrame, min_docs: int, min_chars: int, text: str, doc_id: str) -> DataFrame:
    drops = dropped_positions(docs, min_docs, min_chars, text, doc_id) \
        .select(F.col("doc_id").alias("_drop_id"), F.col("row").alias("_drop_row"), F.col("dropped").alias("_dropped"))
    return docs.join(drops, (F.col(doc_id).cast("long") == F.col("_drop_id"))
                     & (row_hash(F.col(text)) == F.col("_drop_row")), "left")


def kept_text(text: Column, dropped: Column) -> Column:
    def kept(lines):
        at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
        return F.array_join(F.transform(at, lambda i: F.get(lines, i)), "\n")

    return F.when(dropped.isNull(), text).otherwise(let(split_lines(text), kept))


def line_report(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, text): ``text`` is what is left."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kept = kept_text(F.col("text"), F.col("_dropped"))
    return _with_kept(d, min_docs, min_chars, "text", "doc_id").select(
        "doc_id", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text")) \
        .withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))


def dedup(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, text: str = "text",
          doc_id: str = "doc_id") -> DataFrame:
    """The rows and columns of ``docs`` with the repeated lines gone from ``text``."""
    joined = _with_kept(docs, min_docs, min_chars, text, doc_id)
    return joined.select(*[kept_text(docs[c], F.col("_dropped")).alias(c) if c == text else docs[c]
                           for c in docs.columns])
