"""Public tokenizers over units of text, for the operators that count and align tokens.

A text is cut before a space that stands alone between other characters.  There, no pattern of a
byte-level or word-end pre-tokenizer joins what stands on both sides, and no piece of a
SentencePiece model whose pieces hold spaces only in front crosses either, so the tokens of a
text are those of its units in a row (``safe_cuts`` says when this holds; otherwise a unit is a
whole text).  Each distinct unit of a batch is encoded once, in calls of about ``CALL_BYTES``
bytes, so one very long text is encoded in pieces like any other.

Files of two libraries are known by their ending: ``.json`` (tokenizers) and ``.model``
(sentencepiece).  Their path is a parameter; nothing is trained.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

SPACE_MARK = "▁"
CALL_BYTES = 1 << 18
BLOCK_BYTES = 32 << 20

#: fixed values: patterns of the two pre-tokenizers whose matches never hold a space after another character
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def public_path(name: str) -> str:
    """Where a file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] values, then the same for the next."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[ends[k]:ends[k + 1]]; empty ranges give 0."""
    return np.diff(np.append(0, np.cumsum(values))[ends])


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable characters stand
    for themselves, the other bytes are numbered from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Encoder:
    """One tokenizer.  ``encode`` gives the ids of units, without begin, end or other added tokens.

    ``plain_specials``: the strings of special tokens are ordinary text.  Units of a ``.model``
    come with one space in front, in place of the one that the model itself puts there.
    """

    path: str
    plain_specials: bool = False

    def __post_init__(self):
        self.pieces = self.path.endswith(".model")
        if not self.pieces and not self.path.endswith(".json"):
            raise ValueError(f"neither .json nor .model: {self.path}")

    @cached_property
    def tool(self):
        if self.pieces:
            import sentencepiece

            return sentencepiece.SentencePieceProcessor(model_file=self.path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = self.plain_specials
        return t

    @cached_property
    def prefixed(self) -> bool:
        """The model puts a space in front of a text that is not empty."""
        return self.pieces and self._proto.normalizer_spec.add_dummy_prefix

    @cached_property
    def _proto(self):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(self.path, "rb") as f:
            proto.ParseFromString(f.read())
        return proto

    @cached_property
    def safe_cuts(self) -> bool:
        if self.pieces:
            spec, kind = self._proto.normalizer_spec, type(self._proto.pieces[0])
            plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
            return plain and spec.escape_whitespaces and spec.add_dummy_prefix and not any(
                p.type == kind.USER_DEFINED or SPACE_MARK in p.piece.lstrip(SPACE_MARK) for p in self._proto.pieces)
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(" " in t["content"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            return False
        norm, pre = spec["normalizer"], spec["pre_tokenizer"] or {}
        if norm is None and pre.get("type") == "ByteLevel":
            return pre["use_regex"] and not pre["add_prefix_space"]
        parts = pre.get("pretokenizers") or [{}]
        return [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] \
            and parts[0].get("type") == "Split" and parts[0]["pattern"] == {"Regex": WORD_PATTERN} and parts[0]["invert"]

    def encode(self, units: list[str]) -> list:
        """For each unit something with the number of its tokens as length and their ids in ``ids_of``."""
        if self.pieces:
            return self.tool.encode([u[1:] for u in units] if self.prefixed else units, num_threads=1)
        return self.tool.encode_batch_fast(units, add_special_tokens=False)

    def ids_of(self, encoded) -> list[int]:
        return encoded if self.pieces else encoded.ids

    @cached_property
    def spelling(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens in a row, offsets by id): byte-level tokens decoded; U+2581 as a space and
        <0xHH> as that byte in pieces."""
        if self.pieces:
            kind = type(self._proto.pieces[0])
            out = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace(SPACE_MARK, " ").encode()
                   for p in self._proto.pieces]
        else:
            table, vocab = byte_characters(), self.tool.get_vocab(with_added_tokens=True)
            out = [b""] * (max(vocab.values()) + 1)
            for token, k in vocab.items():
                out[k] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        return np.frombuffer(b"".join(out), np.uint8), np.append(0, np.cumsum([len(x) for x in out])).astype(np.int64)


@lru_cache(maxsize=8)
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """An Encoder kept by the worker process, so a file is read once and not in every task."""
    return Encoder(path, plain_specials)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions of single spaces between other characters, one of them ASCII (the other may be
    any, a wider space too)."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    other, ascii_ = data > 0x20, (data > 0x20) & (data < 0x7F)
    return np.flatnonzero((data[1:-1] == 0x20) & other[:-2] & other[2:] & (ascii_[:-2] | ascii_[2:])) + 1


@dataclass
class Units:
    """The units of some texts: ``which[first[k]:first[k + 1]]`` numbers those of text k among ``distinct``."""

    distinct: list[str]
    size: np.ndarray        # bytes of each distinct unit
    which: np.ndarray
    first: np.ndarray


def units_of(texts: list[bytes], spaced: bool, cuts: bool) -> Units:
    """``spaced``: a space is put in front of each text that is not empty; ``cuts``: texts are cut."""
    size = np.array([len(t) + (spaced and len(t) > 0) for t in texts], np.int64)
    data = b"".join(x for t in texts for x in ((b" ", t) if spaced and t else (t,)))
    start = np.append(0, np.cumsum(size))
    at = start[:-1][size > 0]
    if cuts:
        at = np.union1d(at, cut_points(np.frombuffer(data, np.uint8)))
    offsets = np.append(at, len(data)).astype(np.int32 if len(data) < 2 ** 31 else np.int64)
    kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
    column = type(pa.array([], kind)).from_buffers(kind, len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = column.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    return Units([u.decode("utf-8", "replace") for u in distinct], np.array([len(u) for u in distinct], np.int64),
                 coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.searchsorted(at, start))


def calls(units: Units, limit: int = CALL_BYTES):
    """Ranges of distinct units holding about ``limit`` bytes each; one longer unit is a call alone."""
    ends = np.append(0, np.cumsum(units.size))
    i, n = 0, len(units.size)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        yield i, j
        i = j


def count_units(enc: Encoder, units: Units) -> np.ndarray:
    """Tokens of each distinct unit: lengths only."""
    out = [np.fromiter(map(len, enc.encode(units.distinct[i:j])), np.int64, j - i) for i, j in calls(units)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def encode_units(enc: Encoder, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all distinct units in a row, offsets by unit)."""
    ids, sizes = [], []
    for i, j in calls(units):
        got = [enc.ids_of(x) for x in enc.encode(units.distinct[i:j])]
        sizes.append(np.fromiter(map(len, got), np.int64, j - i))
        ids.append(np.fromiter((k for x in got for k in x), np.int32, int(sizes[-1].sum())))
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32),
            np.append(0, np.cumsum(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))))


def blocks(batches, limit: int = BLOCK_BYTES):
    """Arrow batches joined to tables whose last column, the text, holds about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(b.num_columns - 1).nbytes
        if size >= limit:
            held, size = pa.Table.from_batches(held).combine_chunks(), 0       # the batches are not held beside it
            yield held
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def utf8(column) -> list[bytes]:
    """The texts of a column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def one_chunk(column) -> pa.Array:
    """A table's column as one array, whatever it is made of."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
