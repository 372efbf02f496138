"""The operators as queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import align, counts, decontam, html_text, langid, lines, multiindex, quality, runs, shards, simhash, spm, substring
from .common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SHARDS = 24
UPPER, LOWER = lines.UPPER, lines.LOWER


def query(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql is not None:
        ORACLES[fn.__name__] = sql
    return fn


def oracle(sql: str):
    return lambda fn: query(fn, sql)


@oracle(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS g
       FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
             FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
             FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT doc_id, s, k, item FROM dw JOIN bw USING (g, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op1_benchmark_decontamination(spark, sf_dir):
    found = decontam.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def crc_of(col: str):
    """Unsigned CRC-32 of an id as text."""
    return F.crc32(F.col(col).cast("string"))


@query
def op2_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of("doc_id") % 4 == 2, F.lit(False))
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


@query
def op3_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False))
    model = quality.train(docs, read(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@oracle("""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
gone AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
pos AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM gone) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) t
         LEFT JOIN (SELECT doc_id, unnest(ps) AS p, true AS out FROM pos) o USING (doc_id, p) WHERE o.out IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op4_substring_dedup(spark, sf_dir):
    return substring.dedup_substrings(read(spark, sf_dir, "documents"), length=20) \
        .select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op5_html_extraction(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages"))


def _tree_sql(tree) -> str:
    weights: dict = {}
    for x in tree:
        for node in (("", x.region), (x.region, x.rack), (x.rack, str(x.shard))):
            weights[node] = weights.get(node, 0.0) + x.weight
    return ", ".join(f"('{p}', '{c}', {w})" for (p, c), w in weights.items())


def _place_sql(name: str) -> str:
    draw = ("arg_max(c, ln((('0x' || substr(md5(c || '|' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w)")
    step = "SELECT doc_id, {draw} AS node FROM {src} AS q JOIN {name} ON p = node GROUP BY doc_id"
    a = step.format(draw=draw, src="(SELECT doc_id, '' AS node FROM documents)", name=name)
    b = step.format(draw=draw, src=f"({a})", name=name)
    return step.format(draw=draw, src=f"({b})", name=name)


_TREE = shards.uniform_tree(SHARDS)


@oracle(f"""
WITH tree(p, c, w) AS (VALUES {_tree_sql(_TREE)}),
more(p, c, w) AS (VALUES {_tree_sql(shards.grown(_TREE))}),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT],
          list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, tab),
s1 AS ({_place_sql("tree")}), s2 AS ({_place_sql("more")}),
r AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, text_crc32, s1.node::INTEGER AS shard,
             s2.node::INTEGER AS grown_shard
      FROM documents JOIN crc USING (doc_id) JOIN s1 USING (doc_id) JOIN s2 USING (doc_id))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT, doc_id) - 1
            AS BIGINT) AS slot, grown_shard
FROM r""")
def op6_sharding(spark, sf_dir):
    out = shards.assign(read(spark, sf_dir, "documents"), _TREE, shards.grown(_TREE))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@oracle(f"""
WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS lo FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, f.lo IS NOT NULL AND f.lo <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""")
def op7_line_dedup(spark, sf_dir):
    return lines.line_report(read(spark, sf_dir, "documents"), min_docs=2, min_chars=10) \
        .select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query
def op8_sentencepiece(spark, sf_dir):
    return spm.encode(read(spark, sf_dir, "documents"))


@query
def op9_simhash_near_dedup(spark, sf_dir):
    return simhash.link(read(spark, sf_dir, "documents"), shingle=3, bits=2).select("doc_id", "fingerprint", "component_id")


@oracle("""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(u, v) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.u = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN (SELECT u, min(v) AS component_id FROM r GROUP BY u) c ON c.u = e.vec_id""")
def op10_embedding_near_dedup(spark, sf_dir):
    return multiindex.link(read(spark, sf_dir, "embeddings"), threshold=0.93)


def with_planted_runs(docs, text: str = "text", doc_id: str = "doc_id"):
    """In every tenth document by the CRC of its id, the words from one on repeat with a period (the
    contract's rule); such a text is its words joined by one space."""
    h = crc_of(doc_id)
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w"))
    w, n = F.col("_w"), F.col("_n")
    d = d.withColumn("_a", F.when(n > 0, g % n).cast("int"))
    d = d.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    rest = n - F.col("_a")
    unit = F.slice(w, F.col("_a") + 1, F.col("_p"))
    copies = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice(w, F.lit(1), F.col("_a")), copies), " ")
    return d.withColumn(text, F.when(n > 0, planted).otherwise(F.col(text))).drop("_w", "_n", "_a", "_p")


@query
def op11_periodic_runs(spark, sf_dir):
    docs = with_planted_runs(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.find_runs(docs, least=12)
    key = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("at"), (-r["period"]).alias("p")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    top = F.array_max(key)
    d = found.withColumn("top", top)
    length, period = F.col("top.length"), -F.col("top.p")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.at")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_token_counts(spark, sf_dir):
    return counts.token_counts(read(spark, sf_dir, "documents"), counts.public_path("word_bpe_49k.json"), limit=2048)


@query
def op13_tokenizer_alignment(spark, sf_dir):
    return align.align(read(spark, sf_dir, "documents"), align.public_path("byte_bpe_50k.json"),
                       align.public_path("piece_bpe_32k.model"))
