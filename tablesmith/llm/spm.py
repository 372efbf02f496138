"""SentencePiece encoding and decoding: batched Viterbi over the pieces of a given model file.

The pieces and scores come from the file, whose path is a parameter; nothing is trained.  A
text is cut before every run of spaces (no piece holds a space after another character), and
each distinct unit of a batch is segmented once: the hashes of all substrings up to the longest
piece probe the sorted piece hashes, then all units advance one character at a time, longest
first, so units of equal length start and finish together; at each step the vectorised maximum
over the piece lengths stores the back pointer.  Of equal sums the longer last piece wins.
Characters without a piece cost the lowest score less 10 and become their UTF-8 byte pieces.

The segmentation is the one of highest total score.  For a model of type unigram that is the
library's own; for one of type BPE the library applies merges in order instead, so its ids can
differ there, while decoding gives the same text.

Defined cases: null and empty texts have no ids; a literal U+2581 reads as a space, as in the
library; repeated rows get equal results; extra columns are not looked at; decoding replaces
bytes that are not UTF-8 by U+FFFD, and null ids decode to null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, KeyTable, mix, pieces, ship, span_hash, prefix_hash, text_view

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = 0x2581
LONG = 256          # units of more characters are segmented one by one
UNKNOWN_PENALTY = 10.0
PIECE = 2 << 20


@dataclass
class Vocabulary:
    table: KeyTable
    ids: np.ndarray         # piece id by rank in the table
    scores: np.ndarray      # by piece id
    longest: int
    unknown: float          # score of a character without a piece
    unk_id: int
    byte_ids: np.ndarray    # 256 ids, or empty
    spell: list             # UTF-8 bytes of each piece; None for control pieces
    prefix: bool            # a space is put before the text


def vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver; the result (some megabytes, whatever the corpus) is broadcast."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kind = type(proto.pieces[0])
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models without text normalisation are supported")
    scores, spell, keys, ids, byte_ids = np.zeros(len(proto.pieces)), [], [], [], {}
    longest, low = 1, 0.0
    for k, p in enumerate(proto.pieces):
        scores[k] = p.score
        if p.type in (kind.CONTROL, kind.UNKNOWN, kind.UNUSED):
            spell.append(None if p.type == kind.CONTROL else " \u2047 ".encode())
            continue
        if p.type == kind.BYTE:
            spell.append(bytes([int(p.piece[3:5], 16)]))
            byte_ids[int(p.piece[3:5], 16)] = k
            continue
        if "\u2581" in p.piece.lstrip("\u2581"):
            raise ValueError("a piece holds a space after another character")
        if p.type == kind.USER_DEFINED:
            raise ValueError("user-defined pieces are not supported")
        spell.append(p.piece.encode())
        codes = np.frombuffer(p.piece.encode("utf-32-le"), np.uint32)
        keys.append(code_hash(codes[None, :])[0])
        ids.append(k)
        longest, low = max(longest, len(codes)), min(low, p.score)
    table = KeyTable(np.array(keys, np.uint64))
    by_rank = np.zeros(table.size, np.int32)
    by_rank[np.searchsorted(table.keys[:-1], np.array(keys, np.uint64))] = ids
    return Vocabulary(table, by_rank, scores, longest, low - UNKNOWN_PENALTY, sp.unk_id(),
                      np.array([byte_ids[b] for b in range(256)], np.int32) if len(byte_ids) == 256 else np.zeros(0, np.int32),
                      spell, spec.add_dummy_prefix)


def code_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for c in rows.T:
        h = h * np.uint64(BASE) + c.astype(np.uint64) + np.uint64(1)
    return mix(h)


def match(v: Vocabulary, codes: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    """For each length the piece id of the substring at every position, or -1; room: characters to the unit's end."""
    out, h = [], np.zeros(len(codes), np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    at = np.arange(len(codes))
    for k in range(min(v.longest, int(room.max(initial=0)))):
        if k:
            keep = room[at] > k
            at, h = at[keep], h[keep]
        h = h * np.uint64(BASE) + c[at + k]
        ids = np.full(len(codes), -1, np.int32)
        found, rank = v.table.find(mix(h))
        ids[at[found]] = v.ids[rank]
        out.append(ids)
    return out


def segment(v: Vocabulary, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best segmentation of the units codes[start:start + size]: at each piece's first position its
    id (-1: a character without a piece), elsewhere -2."""
    room = np.repeat(start + size, size) - np.arange(len(codes))
    ids = match(v, codes, room)
    token = np.full(len(codes), -2, np.int32)
    order = np.argsort(-size, kind="stable")
    n_long = int((size > LONG).sum())
    for u in order[:n_long].tolist():
        segment_long(v, ids, int(start[u]), int(size[u]), token)
    order = order[n_long:]
    base, size = start[order], size[order]
    if not len(order):
        return token
    back = np.zeros(len(codes), np.int16)
    best = [np.zeros(len(order))]
    for e in range(1, int(size[0]) + 1):
        n = int(np.searchsorted(-size, -e, "right"))        # units of at least e characters
        b = base[:n]
        top, how = np.full(n, -np.inf), np.zeros(n, np.int16)
        for k in range(min(e, len(ids)), 0, -1):            # longest piece first; a later one must be better
            got = ids[k - 1][b + (e - k)]
            score = np.where(got >= 0, v.scores[got], v.unknown if k == 1 else -np.inf) + best[e - k][:n]
            better = score > top
            top[better], how[better] = score[better], k
        best.append(top)
        back[b + (e - 1)] = how
    at = size.copy()
    live = np.arange(len(order))
    while len(live):
        k = back[base[live] + at[live] - 1]
        at[live] -= k
        s = base[live] + at[live]
        for length in np.unique(k).tolist():
            mine = s[k == length]
            token[mine] = ids[length - 1][mine]
        live = live[at[live] > 0]
    return token


def segment_long(v: Vocabulary, ids: list, start: int, size: int, token: np.ndarray) -> None:
    rows = [x[start:start + size].tolist() for x in ids]
    best, back = [0.0] + [0.0] * size, [0] * (size + 1)
    scores = v.scores
    for e in range(1, size + 1):
        top, how = -np.inf, 1
        for k in range(min(e, len(rows)), 0, -1):
            got = rows[k - 1][e - k]
            if got >= 0:
                score = best[e - k] + scores[got]
            elif k == 1:
                score = best[e - 1] + v.unknown
            else:
                continue
            if score > top:
                top, how = score, k
        best[e], back[e] = top, how
    e = size
    while e:
        k = back[e]
        token[start + e - k] = rows[k - 1][e - k]
        e -= k


def encode_texts(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text)."""
    marked = [("\u2581" if v.prefix and t else "") + t.replace(" ", "\u2581") for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    first = np.append(0, np.cumsum([len(t) for t in marked])).astype(np.int64)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space = codes == META
    begin = space & ~np.append(False, space[:-1])
    begin[first[:-1][np.diff(first) > 0]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(codes))
    _, one, unit = np.unique(span_hash(prefix_hash(codes), start, end), return_index=True, return_inverse=True)
    size = (end - start)[one]
    ustart = np.append(0, np.cumsum(size))
    ucodes = codes[ragged(start[one], size)]
    token = segment(v, ucodes, ustart[:-1], size)
    at = np.flatnonzero(token != -2)
    got = token[at]
    n = np.ones(len(at), np.int64)
    unknown = np.flatnonzero(got == -1)
    if len(unknown) and len(v.byte_ids):
        spelled = [chr(c).encode() for c in ucodes[at[unknown]].tolist()]
        n[unknown] = [len(b) for b in spelled]
        out = np.repeat(got, n)
        out[out == -1] = v.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    else:
        out = np.where(got == -1, np.int32(v.unk_id), got)
    per_unit = np.bincount(np.searchsorted(ustart, at, "right") - 1, n, minlength=len(size)).astype(np.int64)
    ufirst = np.append(0, np.cumsum(per_unit))
    counts = per_unit[unit]
    ids = out[ragged(ufirst[:-1][unit], counts)]
    offsets = np.append(0, np.cumsum(counts))[np.searchsorted(start, first)]
    return ids.astype(np.int32), offsets


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] values, then the same for the next."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def decode_ids(v: Vocabulary, ids) -> str:
    text = b"".join(s for s in map(v.spell.__getitem__, ids) if s is not None).decode("utf-8", "replace")
    text = text.replace("\u2581", " ")
    return text[1:] if v.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, path: str = MODEL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) for every row; round_trip: decoding gives the text again."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()),
                        ("round_trip", pa.bool_())])

    def run(batches):
        v = held.value
        for b in batches:
            _, offs = text_view(b.column(1))
            for i, j in pieces(offs, PIECE):
                texts = [t or "" for t in b.column(1).slice(i, j - i).to_pylist()]
                ids, first = encode_texts(v, texts)
                each, f = ids.tolist(), first.tolist()
                same = [decode_ids(v, each[a:z]) == t.replace("\u2581", " ")
                        for a, z, t in zip(f[:-1], f[1:], texts, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids)),
                    pa.array(np.diff(first)), pa.array(same)], schema=schema)

    return ship(d).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) of rows with token ids."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    d = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            texts = [None if x is None else decode_ids(held.value, x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=schema)

    return ship(d).mapInArrow(run, "doc_id long, text string")
