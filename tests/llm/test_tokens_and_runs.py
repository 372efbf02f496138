"""Runs, token counts and alignment against plain brute force, on whole tables and on odd cases."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablesmith.llm import align, counts, queries, runs, tokens

SF = "/root/testdata/sf0.001"
BYTE, WORD, PIECE = (tokens.public_path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# -- periodic runs -------------------------------------------------------------------------------

def brute_runs(words, least):
    """Every maximal stretch with a period, by its definition; the least period of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n_, q) for (s, n_), q in found.items())


def brute_collapse(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_of_random_words_match_brute_force():
    rng = random.Random(5)
    docs = []
    for k in range(300):
        n = rng.choice([0, 1, 5, 12, 30, 60])
        w = [rng.choice("ab" if k % 3 else "abcdef") for _ in range(n)]
        if k % 4 == 0 and n:
            w = w[:3] * rng.randint(1, 9) + w + w[:7] * rng.randint(1, 4)
        docs.append(w)
    first = np.append(0, np.cumsum([len(w) for w in docs]))
    words = np.array([ord(x) - 97 for w in docs for x in w], np.int64)
    for least in (2, 4, 12):
        d, s, n, q = runs.runs_of(words, first, least)
        got = [[] for _ in docs]
        for k, *r in zip(d.tolist(), s.tolist(), n.tolist(), q.tolist(), strict=True):
            got[k].append(tuple(r))
        assert got == [brute_runs(w, least) for w in docs]


def test_suffix_array_and_matches_match_brute_force():
    rng = random.Random(9)
    for n in (1, 2, 50, 400):
        s = np.array([rng.randint(0, 2) for _ in range(n)], np.int64)
        sa, isa = runs.suffix_array(s)
        assert sa.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        assert (isa[sa] == np.arange(n)).all()
    s = np.array([1, 2] * 40 + [3], np.int64)
    p = runs.prefix_hash(s)
    assert runs.match_lengths(s, p, np.array([0, 1]), np.array([2, 5]), np.array([79, 76])).tolist() == [78, 75]


def test_a_text_of_one_word_or_period_is_not_quadratic():
    for period in (1, 2, 7, 1000):
        words = np.arange(60_000, dtype=np.int64) % period
        d, s, n, q = runs.runs_of(words, np.array([0, len(words)]))
        assert (s.tolist(), n.tolist(), q.tolist()) == ([0], [60_000], [period])


def test_runs_query_matches_brute_force(spark, small):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    rows = small.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        w = planted(split(text), doc_id)
        found = brute_runs(w, 12) if len(w) < 1500 else None
        r = got[doc_id]
        if found is None:
            continue
        top = min(((-n, s, q) for s, n, q in found), default=None)
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period) == ((top[1], -top[0], top[2]) if top else (None, None, None))
        assert r.exponent_milli == (1000 * -top[0] // top[2] if top else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == sha(brute_collapse(w, found))
    assert sum(r.n_runs for r in got.values()) > 5


def test_runs_odd_cases(spark, odd, empty):
    rows = [tuple(r) for r in runs.find_runs(odd).collect()]
    assert len(rows) == odd.count()
    for k in (3, 4, 5):
        assert (k, 0, [], "") in rows
    long = next(r for r in rows if r[0] == 7)
    assert long[1] == 5001 and [tuple(x) for x in long[2]] == [(0, 5000, 1)] and long[3] == "word " + "x" * 3000
    assert len([r for r in rows if r[0] == 9]) == 2 and any(r[0] is None and r[1] > 0 for r in rows)
    assert runs.find_runs(empty).count() == 0
    odd_words = spark.createDataFrame([(1, "a\x0ba\tb é 　 " * 30)], "doc_id long, text string")
    r = runs.find_runs(odd_words).first()
    w = split("a\x0ba\tb é 　 " * 30)
    assert [tuple(x) for x in r.runs] == brute_runs(w, 12) and r.collapsed == brute_collapse(w, brute_runs(w, 12))


def test_planted_runs_of_rows_without_id_or_words(spark):
    d = spark.createDataFrame([(None, "a b"), (4, None), (4, ""), (4, " \n")], "doc_id long, text string")
    assert [r.text for r in queries.with_planted_runs(d).collect()] == ["a b", None, "", " \n"]


# -- token counts --------------------------------------------------------------------------------

TRICKY = ["", " ", "a", "a b", " a  b ", "x   y z", "don't  stop 's it's 12 345 !? x", "e ́f é́ g", "▁ a▁b c",
          "a<|endoftext|>b <|endoftext|> c", "<|startoftext|>", "日本語 テキスト と 漢字", "a\tb\nc d\r\ne", "A B Ç ß İ", "\x00 a \x01b", "x " * 3000,
          "<s> </s> <0x41> <unk>", "word" * 500, "🙂 🙂🙂 a", "  lead", "trail  ", "a 　b c", "q\u0085 w"]


def plain_count(path, text):
    if path.endswith(".model"):
        import sentencepiece
        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    from tokenizers import Tokenizer
    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
def test_counts_match_the_library(spark, small, path):
    texts = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()][:120]
    texts += [(1000 + k, t) for k, t in enumerate(TRICKY)] + [(5000, None), (None, "a b c")]
    got = counts.token_counts(spark.createDataFrame(texts, "doc_id long, text string"), path).collect()
    assert len(got) == len(texts)
    assert Counter(tuple(r) for r in got) == Counter(
        (d, len((t or "").encode()), n := plain_count(path, t or ""), n > 2048) for d, t in texts)
    assert tokens.encoder(path).safe_cuts


def test_counts_do_not_depend_on_blocks_or_cuts(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(TRICKY)), pa.int64()), "text": TRICKY})
    for path in (BYTE, WORD, PIECE):
        enc, whole = tokens.encoder(path), []
        for cuts in (True, False):
            units = tokens.units_of(tokens.utf8(pa.Table.from_batches([batch])["text"]), enc.prefixed, cuts)
            whole.append(tokens.sums(tokens.count_units(enc, units)[units.which], units.first).tolist())
        assert whole[0] == whole[1]
    monkeypatch.setattr(tokens, "CALL_BYTES", 5)
    enc = tokens.encoder(BYTE)
    units = tokens.units_of([t.encode() for t in TRICKY], False, True)
    assert tokens.sums(tokens.count_units(enc, units)[units.which], units.first).tolist() == [plain_count(BYTE, t) for t in TRICKY]
    assert [t.num_rows for t in tokens.blocks([batch, batch, batch], batch.column(1).nbytes * 2)] == [2 * len(TRICKY), len(TRICKY)]


def test_counts_odd_cases(odd, empty):
    rows = [tuple(r) for r in counts.token_counts(odd).collect()]
    assert len(rows) == odd.count() and (3, 0, 0, False) in rows and (4, 0, 0, False) in rows
    assert next(r for r in rows if r[0] == 7)[3] is True
    assert counts.token_counts(empty).count() == 0


# -- alignment -----------------------------------------------------------------------------------

def plain_tokens(text):
    """(A tokens, B tokens) as (id, bytes), or None."""
    import sentencepiece
    from tokenizers import Tokenizer
    a, table = Tokenizer.from_file(BYTE), tokens.byte_characters()
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    out_a = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    out_b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        out_b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    same = b"".join(x for _, x in out_a) == want == b"".join(x for _, x in out_b)
    return (out_a, out_b) if text and same else None


def brute_alignment(texts):
    def ranges(ts):
        at = 0
        for i, x in ts:
            yield i, at, at + len(x)
            at += len(x)

    links, out = [], []
    for t in texts:
        both = plain_tokens(t or "")
        if not both:
            links.append([])
            out.append((0, 0, 0, ""))
            continue
        a, b = (list(ranges(x)) for x in both)
        links.append([(i, j) for i, s, e in a for j, u, v in b if s < v and u < e])
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, s, e in a if low < e <= end) + "|" + ",".join(str(i) for i, s, e in b if low < e <= end))
            low = end
        out.append((len(a), len(b), len(groups), sha(";".join(groups))))
    n = Counter(p for x in links for p in x)
    most = {}
    for (_, j), k in n.items():
        most[j] = max(most.get(j, 0), k)
    return [(a, b, g, len(x), sum(n[p] == most[p[1]] for p in x), sum(n[p] for p in x), h)
            for (a, b, g, h), x in zip(out, links, strict=True)]


def test_alignment_matches_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect() if len(r.text or "") < 1500][:70]
    rows += [(1000 + k, t) for k, t in enumerate(TRICKY) if len(t) < 2500]
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (None, rows[1][1]), (2002, None), (2000, "another text of that id")]
    got = align.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute_alignment([t for _, t in rows])
    assert Counter(tuple(r) for r in got) == Counter((d, *w) for (d, _), w in zip(rows, want, strict=True))


def test_alignment_gives_groups_and_survives_many_blocks(spark, small, monkeypatch):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").limit(40).collect()]
    texts = [t for _, t in rows if t]
    copies = np.ones(len(texts), np.int64)
    a, b = tokens.encoder(BYTE, True), tokens.encoder(PIECE)
    got, total, links, ends, codes, n = align.align_block(a, b, [t.encode() for t in texts], copies, digest=False)
    assert n.sum() == total["n_links"].sum() == (total["n_a"] + total["n_b"] - total["n_groups"]).sum()
    for t, (groups, _), k in zip(texts, got, total["n_a"].tolist(), strict=True):
        ids = [int(x) for g in groups.split(";") for x in g.split("|")[0].split(",")] if groups else []
        assert len(ids) == k and (not ids or a.tool.decode(ids) == " " + t)
    assert len(codes) == len(set(codes.tolist())) and ends[-1] == len(links)


def test_alignment_in_slices_is_that_of_the_whole_block_in_less_memory(monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 14)))
    texts = [" ".join(word() for _ in range(2000)) for _ in range(80)] + ["naïve ▁ x", "", "  ", "日本語 text"]
    texts = [t.encode() for t in texts]
    a, b = tokens.encoder(BYTE, True), tokens.encoder(PIECE)
    copies = np.arange(1, len(texts) + 1)
    align.align_block(a, b, texts[-4:], copies[-4:])        # loads the tokenizers

    def peak():
        tracemalloc.start()
        out = align.align_block(a, b, texts, copies)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    got, least = peak()
    assert least < 100 * sum(map(len, texts))       # 71, and 150 in one piece
    monkeypatch.setattr(align, "SLICE_BYTES", 1 << 40)
    want, _ = peak()
    assert got[0] == want[0]
    assert all((got[1][c] == want[1][c]).all() for c in align.MEASURES[:4])
    assert all((x == y).all() for x, y in zip(got[2:], want[2:], strict=True))


def test_alignment_odd_cases(odd, empty):
    rows = [tuple(r) for r in align.align(odd).collect()]
    assert len(rows) == odd.count()
    assert {r for r in rows if r[0] in (3, 4)} == {(3, 0, 0, 0, 0, 0, 0, ""), (4, 0, 0, 0, 0, 0, 0, "")}
    same = {r[1:] for r in rows if r[0] in (1, 9, None) and r[1] > 5}
    assert len(same) == 1 and len([r for r in rows if r[0] == 9]) == 2
    assert align.align(empty).count() == 0
