"""Operators on texts against plain brute force, on the smallest tables and on odd cases."""

import re

import pytest
import xxhash


from tablesmith.llm import decontam, lines, simhash, substring

SF = "/root/testdata/sf0.001"


def lower(s):
    return (s or "").translate({k: k + 32 for k in range(65, 91)})


def sha(s):
    import hashlib
    return hashlib.sha256(s.encode()).hexdigest()


def by_id(rows):
    return {r.doc_id: r for r in rows}


# -- substring dedup -----------------------------------------------------------------------------

def brute_substrings(texts, length):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in texts}
    seen, out = set(), {}
    for d in sorted(words):
        w = words[d]
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            key = tuple(w[s:s + length])
            if key in seen:
                gone[s:s + length] = [True] * length
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), len(w) - len(kept), sha(" ".join(kept)))
    return out


def test_substrings_match_brute_force(small):
    rows = small.select("doc_id", "text").collect()
    want = brute_substrings([(r.doc_id, r.text) for r in rows], 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(small).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_substrings_odd_cases(odd, empty):
    rows = substring.dedup_substrings(odd, length=5).collect()
    assert len(rows) == odd.count()
    got = [(r.doc_id, r.n_words, r.n_removed) for r in rows]
    assert got.count((9, 22, 22)) == 2                    # repeated rows agree
    assert (None, 22, 0) in got and (1, 22, 0) in got     # a row without id is not compared
    assert (3, 0, 0) in got and (4, 0, 0) in got and (5, 0, 0) in got
    assert next(x for x in got if x[0] == 7) == (7, 5001, 4999)
    assert substring.dedup_substrings(empty).count() == 0


def test_substrings_cross_flushes_and_buckets(small, monkeypatch):
    want = {r.doc_id: r.kept_sha256 for r in substring.dedup_substrings(small).collect()}
    monkeypatch.setattr(substring, "BUCKET_WINDOWS", 2000)
    got = {r.doc_id: r.kept_sha256 for r in substring.dedup_substrings(small.repartition(5)).collect()}
    assert got == want


def test_substrings_dealt_in_two_rounds(small, monkeypatch):
    """From FAN buckets on windows and marks are dealt to groups of buckets first; nothing else changes."""
    want = {r.doc_id: r.kept_sha256 for r in substring.dedup_substrings(small).collect()}
    for fan, bucket in ((1, 2000), (3, 1000)):
        monkeypatch.setattr(substring, "FAN", fan)
        monkeypatch.setattr(substring, "BUCKET_WINDOWS", bucket)
        plan = substring.repeated_spans(small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") >= 3
        got = {r.doc_id: r.kept_sha256 for r in substring.dedup_substrings(small.repartition(5)).collect()}
        assert got == want


def test_substrings_second_round_keeps_repeats_of_other_flushes():
    """Two shares of one window: the later one becomes a mark, dealt by way of a bucket of its group of parts."""
    import pyarrow as pa
    text = " ".join(f"w{i}" for i in range(30))
    shares = []
    for doc in (7, 5):
        batch = pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([0]), pa.array([text])], names=["doc_id", "tag", "text"])
        shares += [r for b in substring.window_shares(20, 12, 3)(iter([batch])) for r in b.to_pylist()]
    batch = substring.arrow_rows([tuple(r.values()) for r in shares], substring.SHARE_ARROW)
    out = [r for b in substring.split_shares(12, 3)(iter([batch])) for r in b.to_pylist()]
    marks = [(r["ids"], r["tags"], r["counts"], r["gaps"]) for r in out if r["hashes"] is None]
    ids, _, starts = substring.unpacked_marks(marks)
    assert set(ids.tolist()) == {7} and sorted(starts.tolist()) == list(range(11))
    kept = [substring.unpacked_share(r["ids"], r["tags"], r["counts"], r["gaps"]) for r in out if r["hashes"] is not None]
    assert sorted(int(x) for k in kept for x in k[1]) == list(range(11)) and all(set(k[2].tolist()) == {5} for k in kept)
    assert all(r["subs"] == b"" for r in out if r["hashes"] is not None)


def test_substrings_of_a_hot_passage_reach_a_bucket_once(spark, monkeypatch):
    """However often a window occurs in a flush, its bucket gets it once; documents are dealt by hash."""
    import pyarrow as pa

    passage = " ".join(f"p{k}" for k in range(30))
    texts = [(8 * k, f"{passage} own{k} " + "same " * 40) for k in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in texts], pa.int64()),
                                        "tag": pa.array([0] * len(texts), pa.int64()), "text": [t for _, t in texts]})
    shares = [r for b in substring.window_shares(20, 8)(iter([batch])) for r in b.to_pylist()]
    hashes = [r["hashes"] for r in shares if r["hashes"] is not None]
    windows = {tuple(w[s:s + 20]) for _, t in texts for w in [t.split()] for s in range(len(w) - 19)}
    assert sum(map(len, hashes)) == 8 * len(windows)
    assert {r["bucket"] for r in shares if r["hashes"] is None} == set(range(8))
    want = brute_substrings(texts, 20)
    monkeypatch.setattr(substring, "BUCKET_WINDOWS", 2000)
    for flush in (1 << 20, 500):
        monkeypatch.setattr(substring, "FLUSH_WINDOWS", flush)
        df = spark.createDataFrame(texts + texts[:3], "doc_id long, text string").repartition(3)
        got = [(r.doc_id, (r.n_words, r.n_removed, r.kept_sha256)) for r in substring.dedup_substrings(df).collect()]
        assert len(got) == 403 and all(want[d] == x for d, x in got)


# -- line dedup ----------------------------------------------------------------------------------

def brute_lines(texts, min_docs=2, min_chars=10):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    docs = {}
    for d, t in texts:
        docs.setdefault(d, (t or "").split("\n"))
    own = {}
    for d, ls in docs.items():
        for line in ls:
            own.setdefault(key(line), set()).add(d)
    out = {}
    for d, ls in docs.items():
        kept = [x for x in ls if len(key(x)) < min_chars or len(own[key(x)]) < min_docs or min(own[key(x)]) == d]
        out[d] = (len(ls), len(ls) - len(kept), sha("\n".join(kept)))
    return out


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_match_brute_force(small, min_docs):
    rows = small.select("doc_id", "text").collect()
    want = brute_lines([(r.doc_id, r.text) for r in rows], min_docs)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_report(small, min_docs).collect()}
    assert got == want


def test_lines_odd_cases(odd, empty):
    rows = lines.line_report(odd).collect()
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows]
    assert (2, 2, 1, "other words here") in got
    assert got.count((9, 3, 2, "short")) == 2
    assert (3, 1, 0, None) in got and (4, 1, 0, "") in got
    assert [x[2] for x in got if x[0] is None] == [0]
    assert (8, 2, 1, "été à Noël, 日本語 テキスト\r") in got
    assert lines.dedup(odd).columns == odd.columns and lines.dedup(odd).count() == odd.count()
    assert lines.line_report(empty).count() == 0


def test_lines_run_no_python(small):
    plan = lines.line_report(small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- decontamination -----------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scan(texts, items, n=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        k = min(n, len(w))
        for s in range(len(w) - k + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[s:s + k]), set()).add(str(i))
    out = {}
    for d, t in texts:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if items_of := windows.get(tuple(w[s:s + k])):
                    hit |= set(range(s, s + k))
                    found |= items_of
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def scanned(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


@pytest.mark.parametrize("block", [500_000, 60])
def test_scan_matches_brute_force(spark, small, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_NGRAMS", block)       # 60: many blocks, hits joined by document
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_scan([(r.doc_id, r.text) for r in small.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert scanned(decontam.scan(small, bench)) == want and any(x[4] for x in want.values())


def test_scan_odd_cases(spark, odd, empty):
    bench = spark.createDataFrame([(10, "Lazy DOG"), (9, "shared-line, of"), (7, None), (5, ""), (None, "one"), (9, "été")],
                                  "item_id long, text string")
    got = scanned(decontam.scan(odd, bench))
    assert got[1][1:3] == (5, 2) and got[1][3] == sha("10,9") and got[2][2] == 1
    assert got[8][1:3] == (4, 1) and got[3] == (0, 0, 0, sha(""), False) and got[6][4] is False
    assert decontam.scan(odd, bench).count() == odd.count()
    assert not any(x[4] for x in scanned(decontam.scan(odd, bench.limit(0))).values())
    assert decontam.scan(empty, bench).count() == 0
    kept = decontam.decontaminate(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [3, 4, 5, 6, 7]
    spans = decontam.decontaminate(odd, bench, max_hit_share=0.9)
    assert by_id(spans.collect())[2].text == "  a  text \nother words here" and spans.count() == odd.count()


@pytest.mark.parametrize("block", [500_000, 2])
def test_contaminated_rows_without_id_or_with_a_shared_one(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_NGRAMS", block)
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "one two three four")], "item_id long, text string")
    rows = [(None, "x alpha beta gamma y"), (None, "clean"), (None, None), (5, "so alpha beta gamma"), (5, "clean too"),
            (5, "one two three four five"), (5, "clean too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontam.decontaminate(docs, bench, n=3)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[k] for k in (1, 2, 4, 6)]))
    cut = decontam.decontaminate(docs, bench, n=3, max_hit_share=1.0)
    assert sorted(str(r.text) for r in cut.collect()) == sorted(["x  y", "clean", "None", "so ", "clean too", " five", "clean too"])


# -- SimHash -------------------------------------------------------------------------------------

def brute_simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    k = min(3, len(w))
    counts, n = [0] * 64, 0
    for s in range(len(w) - k + 1 if w else 0):
        h = xxhash.xxh64_intdigest(" ".join(w[s:s + k]).encode(), 42)
        n += 1
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > n)


def brute_components(fps, bits):
    ids, parent = sorted(fps), {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(small):
    fps = {r.doc_id: brute_simhash(r.text) for r in small.collect()}
    comp = brute_components(fps, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.link(small).collect()}
    assert got == {i: (format(f, "016x"), comp[i]) for i, f in fps.items()}


@pytest.mark.parametrize(("hot", "bits"), [(64, 2), (3, 2), (64, 0), (3, 4), (64, 6)])
def test_simhash_links_of_dense_fingerprints(spark, monkeypatch, hot, bits):
    """Fingerprints in balls and chains: every component is found, also where keys are hot."""
    import random

    rnd, fps = random.Random(bits + hot), {}
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rnd.randrange(0, 7)):
                x ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.5:
                base = x
            fps[len(fps) + 5] = x
    monkeypatch.setattr(simhash, "HOT", hot)
    distinct = {}
    for i, x in fps.items():
        distinct.setdefault(x, i)
    classes = spark.createDataFrame([(i, simhash.signed(x)) for x, i in distinct.items()], "rep long, fp long")
    from tablesmith.llm.common import components
    got = {r.node: r.component for r in components(simhash.links(classes, bits)).collect()}
    want = brute_components({i: x for x, i in distinct.items()}, bits)
    assert {i: got.get(i, i) for i in want} == want


def test_simhash_odd_cases(odd, empty):
    rows = simhash.link(odd).collect()
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in rows]
    zero = "0" * 16
    assert len(rows) == odd.count() and {(3, zero, 3), (4, zero, 3), (5, zero, 3)} <= set(got)
    assert sum(x[2] == 1 for x in got) == 4 and [x[2] for x in got if x[0] is None] == [1]
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 6, 7, 8]
    assert simhash.link(empty).count() == 0 and simhash.dedup(empty).count() == 0


# -- rows that share a doc_id --------------------------------------------------------------------

def test_line_dedup_keeps_the_lines_of_another_text_of_a_doc_id(spark):
    rows = [(1, "aaaaaaaaaaaa\nxx"), (2, "aaaaaaaaaaaa\nbb"), (2, "unique line here\ncc"), (2, "unique line here\ncc"), (2, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text or "") for r in lines.dedup(d).collect()) == [
        (1, "aaaaaaaaaaaa\nxx"), (2, ""), (2, "bb"), (2, "unique line here\ncc"), (2, "unique line here\ncc")]
    assert sorted(r.n_dropped for r in lines.line_report(d).collect()) == [0, 0, 0, 0, 1]


def test_line_dedup_of_a_very_long_text(spark):
    """Linear in the lines of one text: a quadratic plan would not end."""
    import time

    shared = [f"a line that is shared {k}" for k in range(0, 100_000, 2)]
    long = "\n".join(x for k in range(50_000) for x in (shared[k], f"own {k}"))
    d = spark.createDataFrame([(1, "\n".join(shared)), (2, long)], "doc_id long, text string")
    lines.line_report(d).count()
    t = time.time()
    r = {x.doc_id: x for x in lines.line_report(d).collect()}
    assert r[2].n_dropped == 50_000 and r[2].text == "\n".join(f"own {k}" for k in range(50_000))
    assert time.time() - t < 15


def test_substrings_of_another_text_of_a_doc_id_stay(spark):
    same = " ".join(f"s{k}" for k in range(25))
    own = " ".join(f"o{k}" for k in range(25))
    rows = [(1, same), (2, same + " end"), (2, own), (2, own), (2, "x " + own), (3, own), (2, None), (2, "short")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):
        got = [(r.doc_id, r.text, r.n_removed) for r in substring.dedup_substrings(d.repartition(parts)).collect()]
        assert (1, same, 0) in got and (2, "end", 25) in got and (3, "", 25) in got and (2, "short", 0) in got
        # of the two texts with the words of ``own`` one keeps them, by the order of their hashes
        texts = sorted(t for i, t, _ in got if i == 2 and t and t[0] in "ox")
        assert texts in ([own, own, "x"], ["x " + own])


def test_substrings_of_rows_with_one_id_are_texts_of_their_own(spark, small):
    """All documents under one doc_id: the same windows go as with ids in the order of the texts' hashes."""
    from pyspark.sql import functions as F

    d = small.select("text").where("text IS NOT NULL").distinct()
    one = d.select(F.lit(7).cast("long").alias("doc_id"), "text")
    ranked = d.select(F.xxhash64("text").alias("doc_id"), "text")
    got = sorted(r.kept_sha256 for r in substring.dedup_substrings(one).collect())
    assert got == sorted(r.kept_sha256 for r in substring.dedup_substrings(ranked).collect())


def test_simhash_dedup_keeps_another_text_of_a_doc_id(spark):
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (2, a), (2, b), (3, b), (None, b)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.dedup(d).collect()) == [(0, b), (1, a), (2, b)]
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.link(d).collect())
    assert got == [(0, 2), (1, 1), (2, 1), (2, 2), (3, 2)]


def test_simhash_chains_prune_before_the_full_distance(spark):
    """Of the pairs that share a key, most break a chain's budget; every near pair survives the chains of some key."""
    import random

    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        fps |= {x} | {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)}
        fps |= {x ^ rng.getrandbits(24) << 8 * rng.randrange(6) for _ in range(25)}
    values = sorted(simhash.signed(f) for f in fps)
    classes = spark.createDataFrame([(v, v) for v in values], "rep long, fp long")
    pairs = simhash.candidates(simhash.key_rows(classes, 2))
    kept = simhash.chained(pairs, 2).selectExpr("a.rep AS u", "b.rep AS v").collect()
    near = {(u, v) for u in values for v in values if u < v and bin((u ^ v) & (2 ** 64 - 1)).count("1") <= 2}
    assert near <= {(r.u, r.v) for r in kept}
    assert len(kept) < 0.6 * pairs.count()
    assert {tuple(sorted(r)) for r in simhash.links(classes, 2).collect()} == near
