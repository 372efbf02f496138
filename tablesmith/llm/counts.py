"""Token counts: whole texts are encoded in Arrow batches and only the lengths come back.

A task joins its batches to about 32 MB of text, cuts the texts at safe boundaries (see
``tokens``), encodes each distinct unit once in calls balanced by bytes, and adds the lengths up
by text.  Nothing is shuffled, and what a task holds does not depend on the length of a text
beyond that text itself.

Defined cases: null and empty texts have no bytes and no tokens; a row without doc_id is
counted like any other; repeated rows get equal results; extra columns are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .tokens import blocks, count_units, encoder, one_chunk, public_path, sums, units_of, utf8

LIMIT = 2048


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, as the library of the tokenizer file at
    ``path`` counts, without begin, end or added special tokens; the strings of special tokens inside
    a text are read as that library does by default.  over_limit: more than ``limit`` tokens."""
    path = path or public_path("word_bpe_49k.json")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        enc = encoder(path)
        for b in blocks(batches):
            texts = utf8(b.column(1))
            units = units_of(texts, enc.prefixed, enc.safe_cuts)
            n = sums(count_units(enc, units)[units.which], units.first)
            yield pa.RecordBatch.from_arrays(
                [one_chunk(b.column(0)), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return ship(d).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
