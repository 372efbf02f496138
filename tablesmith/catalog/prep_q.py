"""Checked queries: splits, imputation, outliers, encoding, scaling, plans and the
preparation flows (D-*, N-*, O-*, E-*, K-*, L-*, K-11, K-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_hash_int
from ..operators import encode as E
from ..operators import impute as N
from ..operators import outliers as O
from ..operators import sample as D
from ..operators import scale as K
from ..plans import column_plan as L
from ..plans import preprocess as PP
from ..session import checkpoint
from ..sources.tables import view, with_views
from . import register, rounded, sql_round, sql_union

T = "l_returnflag"


def li_split(spark, sf, *cols):
    """The stratified split; with columns for fits, which read it several times, it is written once, and so are the
    rows with their hashed ids, which the split scans three times."""
    d = view(spark, sf, "li").select("_rid", T, *cols)
    out = D.split_stratified(checkpoint(d) if cols else d, T, 0.2, 42)
    return checkpoint(out) if cols else out


# li with the stratified split, in DuckDB (largest remainder over classes, hash rank)
SPLIT_CTE = f"""
lh AS (SELECT *, {sql_hash_int('_rid', 42)} AS hv FROM li),
cnt AS (SELECT {T}, count(*) AS n FROM li GROUP BY {T}),
tot AS (SELECT ceil(count(*) * 0.2) AS t, count(*) AS nn FROM li),
al AS (SELECT {T}, n, t * n / nn AS ex, t FROM cnt, tot),
al2 AS (SELECT *, floor(ex) AS base, ex - floor(ex) AS rem FROM al),
al3 AS (SELECT {T}, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, {T})
                               <= max(t) OVER () - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM al2),
ls AS (SELECT lh.* EXCLUDE (hv), CASE WHEN row_number() OVER (PARTITION BY {T} ORDER BY hv, _rid) <= take
                                   THEN 'test' ELSE 'train' END AS _split
       FROM lh JOIN al3 USING ({T}))"""


def with_split(sql: str) -> str:
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        body = body[5:]
        return with_views(f"WITH {SPLIT_CTE},\n{body}", "li")
    return with_views(f"WITH {SPLIT_CTE}\n{body}", "li")


# ------------------------------------------------------------------ D-2, D-3, D-4, D-5

@register("split_stratified", with_split(f"SELECT _rid, {T}, _split FROM ls"))
def split_stratified(spark, sf):
    return li_split(spark, sf).select("_rid", T, "_split")


@register("split_random", with_views(f"""
SELECT _rid, CASE WHEN row_number() OVER (ORDER BY {sql_hash_int('_rid', 7)}, _rid) <= (SELECT ceil(count(*) * 0.25) FROM li)
            THEN 'test' ELSE 'train' END AS _split FROM li""", "li"))
def split_random(spark, sf):
    return D.split_random(view(spark, sf, "li"), 0.25, 7).select("_rid", "_split")


@register("split_ordered", with_views("""
SELECT _rid, CASE WHEN row_number() OVER (ORDER BY _rid) > (SELECT count(*) - ceil(count(*) * 0.2) FROM li)
            THEN 'test' ELSE 'train' END AS _split FROM li""", "li"))
def split_ordered(spark, sf):
    return D.split_ordered(view(spark, sf, "li"), 0.2).select("_rid", "_split")


@register("kfold_assign", with_views(f"""
SELECT _rid, {T}, CAST((row_number() OVER (PARTITION BY {T} ORDER BY {sql_hash_int('_rid', 42)}, _rid) - 1) % 5 AS INTEGER) AS _fold
FROM li""", "li"))
def kfold_assign(spark, sf):
    return D.kfold_assign(view(spark, sf, "li"), 5, T, 42).select("_rid", T, "_fold")


@register("kfold_missing_class", with_views(f"""
SELECT _rid, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY {sql_hash_int('_rid', 42)}, _rid) - 1) % 5 AS INTEGER) AS _fold
FROM docs""", "docs"))
def kfold_missing_class(spark, sf):
    """Rows without a class are folded as a class of their own."""
    return D.kfold_assign(view(spark, sf, "docs"), 5, "toxic", 42).select("_rid", "toxic", "_fold")


@register("drop_rare_classes", with_views("""
SELECT _rid, source FROM docs WHERE source IN (SELECT source FROM docs GROUP BY source HAVING count(*) >= 40)""", "docs"))
def drop_rare_classes(spark, sf):
    return D.drop_rare_classes(view(spark, sf, "docs"), "source", 40).select("_rid", "source")


@register("dedupe_exact", with_views("""
SELECT min(_rid) AS _rid, l_orderkey, l_linenumber, l_quantity FROM li_dup
GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus, l_shipdate""", "li_dup"))
def dedupe_exact(spark, sf):
    d = view(spark, sf, "li_dup")
    cols = [x for x in d.columns if not x.startswith("_")]
    return D.dedupe_exact(d, cols).select("_rid", "l_orderkey", "l_linenumber", "l_quantity")


@register("sample_guard", with_views(f"""
SELECT count(*)::BIGINT AS kept FROM li
WHERE NOT ((SELECT count(*) FROM li) > 50000) OR {sql_hash_int('_rid', 42)} / 4294967296.0 < least(0.05, 500000.0 / (SELECT count(*) FROM li))""", "li"))
def sample_guard(spark, sf):
    return D.sample_guard(view(spark, sf, "li"), max_rows=50000).agg(F.count(F.lit(1)).cast("long").alias("kept"))


@register("head_n", with_views("SELECT _rid, l_orderkey, l_quantity FROM li ORDER BY _rid LIMIT 3", "li"))
def head_n(spark, sf):
    return D.head_n(view(spark, sf, "li"), 3).select("_rid", "l_orderkey", "l_quantity")


@register("shuffle_order", with_views(f"""
SELECT _rid, row_number() OVER (ORDER BY {sql_hash_int('_rid', 42)}, _rid)::BIGINT AS pos FROM li""", "li"))
def shuffle_order(spark, sf):
    s = D.shuffle_order(view(spark, sf, "li"), 42)
    return D.rank_by_hash(s, "_rid", 42, name="pos").select("_rid", (F.col("pos") + 1).cast("long").alias("pos"))


# ------------------------------------------------------------------ N-1 … N-6, PF-5

def _impute_q(spark, sf, methods, cols):
    d = li_split(spark, sf, *cols)
    out = N.apply_impute(d, N.fit_impute(d, methods))
    return rounded(out.select("_rid", "_split", *cols))


@register("impute_median", with_split("""
SELECT _rid, _split, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM ls WHERE _split = 'train')) AS l_quantity,
       coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM ls WHERE _split = 'train')) AS l_tax FROM ls"""))
def impute_median(spark, sf):
    return _impute_q(spark, sf, {"l_quantity": "median", "l_tax": "median"}, ["l_quantity", "l_tax"])


ORACLES_ROUND = ["l_quantity", "l_tax"]


@register("impute_mean", with_split(sql_round("""
SELECT _rid, _split, coalesce(l_quantity, (SELECT avg(l_quantity) FROM ls WHERE _split = 'train')) AS l_quantity,
       coalesce(l_tax, (SELECT avg(l_tax) FROM ls WHERE _split = 'train')) AS l_tax FROM ls""", ORACLES_ROUND)))
def impute_mean(spark, sf):
    return _impute_q(spark, sf, {"l_quantity": "mean", "l_tax": "mean"}, ["l_quantity", "l_tax"])


@register("impute_mode", with_split("""
SELECT _rid, _split, coalesce(l_linestatus, (SELECT l_linestatus FROM ls WHERE _split = 'train' AND l_linestatus IS NOT NULL
                                             GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_linestatus FROM ls"""))
def impute_mode(spark, sf):
    d = li_split(spark, sf, "l_linestatus")
    return N.apply_impute(d, N.fit_impute(d, {"l_linestatus": "mode"})).select("_rid", "_split", "l_linestatus")


@register("impute_constant", with_views("""
SELECT _rid, coalesce(l_quantity, 0.0) AS l_quantity, coalesce(l_linestatus, 'missing') AS l_linestatus FROM li""", "li"))
def impute_constant(spark, sf):
    d = view(spark, sf, "li")
    return rounded(N.apply_impute(d, N.fit_impute(d, {"l_quantity": "constant", "l_linestatus": "constant"}))
                   .select("_rid", "l_quantity", "l_linestatus"))


@register("impute_indicator", with_split("""
SELECT _rid, CAST(l_quantity IS NULL AS INTEGER) AS l_quantity__missing,
       coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM ls WHERE _split = 'train')) AS l_quantity,
       CAST(l_linestatus IS NULL AS INTEGER) AS l_linestatus__missing,
       coalesce(l_linestatus, 'missing') AS l_linestatus FROM ls"""))
def impute_indicator(spark, sf):
    d = li_split(spark, sf, "l_quantity", "l_linestatus")
    out = N.apply_impute(d, N.fit_impute(d, {"l_quantity": "indicator", "l_linestatus": "indicator"}))
    return out.select("_rid", "l_quantity__missing", "l_quantity", "l_linestatus__missing", "l_linestatus")


@register("impute_datetime", with_split("""
SELECT _rid, coalesce(l_shipdate, (SELECT l_shipdate FROM ls WHERE _split = 'train' AND l_shipdate IS NOT NULL
                                   GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_shipdate FROM ls"""))
def impute_datetime(spark, sf):
    d = li_split(spark, sf, "l_shipdate")
    return N.apply_impute(d, N.fit_impute(d, {"l_shipdate": "mode"})).select("_rid", "l_shipdate")


@register("drop_rows_missing", with_split("""
SELECT _split, count(*)::BIGINT AS n FROM ls WHERE l_quantity IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY _split"""))
def drop_rows_missing(spark, sf):
    d = N.drop_rows_missing(li_split(spark, sf, *NUMS, "l_linestatus"), ["l_quantity", "l_linestatus"])
    return d.groupBy("_split").agg(F.count(F.lit(1)).cast("long").alias("n"))


# ------------------------------------------------------------------ O-1 … O-5

NUMS = ["l_quantity", "l_extendedprice", "l_tax"]


def _fence_sql(cols, lo_p, hi_p, iqr=True):
    parts = []
    for x in cols:
        if iqr:
            parts.append(f"(SELECT quantile_cont({x}, 0.25) - 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) FROM ls WHERE _split = 'train') AS lo_{x}, "
                         f"(SELECT quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) FROM ls WHERE _split = 'train') AS hi_{x}")
        else:
            parts.append(f"(SELECT quantile_cont({x}, {lo_p}) FROM ls WHERE _split = 'train') AS lo_{x}, "
                         f"(SELECT quantile_cont({x}, {hi_p}) FROM ls WHERE _split = 'train') AS hi_{x}")
    return ", ".join(parts)


def _clip_sql(iqr):
    sel = ", ".join(f"CASE WHEN {x} IS NOT NULL THEN least(greatest(CAST({x} AS DOUBLE), lo_{x}), hi_{x}) END AS {x}" for x in NUMS)
    return with_split(sql_round(f"SELECT _rid, _split, {sel} FROM ls, (SELECT {_fence_sql(NUMS, 0.01, 0.99, iqr)}) f", NUMS))


@register("clip_iqr", _clip_sql(True))
def clip_iqr(spark, sf):
    d = li_split(spark, sf, *NUMS)
    return rounded(O.apply_clip(d, O.fit_bounds(d, NUMS, "iqr")).select("_rid", "_split", *NUMS))


@register("clip_quantile", _clip_sql(False))
def clip_quantile(spark, sf):
    d = li_split(spark, sf, *NUMS)
    return rounded(O.apply_clip(d, O.fit_bounds(d, NUMS, "quantile")).select("_rid", "_split", *NUMS))


@register("signed_log", with_views(sql_round("""
SELECT _rid, sign(l_extendedprice - 40000) * ln(1 + abs(l_extendedprice - 40000)) AS x FROM li""", ["x"]), "li"))
def signed_log(spark, sf):
    d = view(spark, sf, "li").select("_rid", (F.col("l_extendedprice") - 40000).alias("x"))
    return rounded(O.signed_log(d, ["x"]))


@register("remove_outlier_rows", with_split(f"""
SELECT _split, count(*)::BIGINT AS n FROM ls, (SELECT {_fence_sql(NUMS, 0, 0, True)}) f
WHERE NOT (coalesce(l_quantity < lo_l_quantity OR l_quantity > hi_l_quantity, false)
        OR coalesce(l_extendedprice < lo_l_extendedprice OR l_extendedprice > hi_l_extendedprice, false)
        OR coalesce(l_tax < lo_l_tax OR l_tax > hi_l_tax, false)) GROUP BY _split"""))
def remove_outlier_rows(spark, sf):
    d = li_split(spark, sf, *NUMS)
    out = O.remove_outlier_rows(d, O.fit_bounds(d, NUMS, "iqr"))
    return out.groupBy("_split").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("remove_outlier_rows_capped", with_split(f"""
WITH fl AS (SELECT _rid FROM ls, (SELECT {_fence_sql(['l_extendedprice'], 0.01, 0.99, False)}) f
            WHERE coalesce(l_extendedprice < lo_l_extendedprice OR l_extendedprice > hi_l_extendedprice, false)),
cap AS (SELECT greatest(1, floor((SELECT count(*) FROM ls) * 0.02)) AS m),
dr AS (SELECT _rid FROM (SELECT _rid, row_number() OVER (ORDER BY _rid) AS r FROM fl) WHERE r <= (SELECT m FROM cap))
SELECT _split, count(*)::BIGINT AS n FROM ls WHERE _rid NOT IN (SELECT _rid FROM dr) GROUP BY _split"""))
def remove_outlier_rows_capped(spark, sf):
    d = li_split(spark, sf, "l_extendedprice")
    out = O.remove_outlier_rows_capped(d, O.fit_bounds(d, ["l_extendedprice"], "quantile"), cap_ratio=0.02)
    return out.groupBy("_split").agg(F.count(F.lit(1)).cast("long").alias("n"))


# ------------------------------------------------------------------ E-1 … E-9

@register("onehot", with_split("""
SELECT _rid, CAST(coalesce(l_linestatus = 'F', false) AS INTEGER) AS l_linestatus__F,
       CAST(coalesce(l_linestatus = 'O', false) AS INTEGER) AS l_linestatus__O FROM ls"""))
def onehot(spark, sf):
    d = li_split(spark, sf, "l_linestatus")
    return E.apply_onehot(d, E.fit_onehot(d, ["l_linestatus"])).select("_rid", "l_linestatus__F", "l_linestatus__O")


@register("onehot_drop_first", with_views("""
SELECT _rid, CAST(coalesce(o_orderpriority = '2-HIGH', false) AS INTEGER) AS "o_orderpriority_2-HIGH",
       CAST(coalesce(o_orderpriority = '3-MEDIUM', false) AS INTEGER) AS "o_orderpriority_3-MEDIUM",
       CAST(coalesce(o_orderpriority = '4-NOT SPECIFIED', false) AS INTEGER) AS "o_orderpriority_4-NOT SPECIFIED",
       CAST(coalesce(o_orderpriority = '5-LOW', false) AS INTEGER) AS "o_orderpriority_5-LOW" FROM ord""", "ord"))
def onehot_drop_first(spark, sf):
    d = view(spark, sf, "ord").select("_rid", "o_orderpriority")
    return E.dummies(d, ["o_orderpriority"], drop_first=True)


@register("label_encode", with_split("""
WITH m AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS BIGINT) AS code
           FROM (SELECT DISTINCT CAST(l_shipdate AS VARCHAR) AS v FROM ls WHERE _split = 'train' AND l_shipdate IS NOT NULL))
SELECT _rid, _split, coalesce(m.code, -1) AS l_shipdate FROM ls LEFT JOIN m ON CAST(ls.l_shipdate AS VARCHAR) = m.v"""))
def label_encode(spark, sf):
    d = li_split(spark, sf, "l_shipdate")
    return E.apply_label(d, E.fit_label(d, ["l_shipdate"])).select("_rid", "_split", "l_shipdate")


@register("frequency_encode", with_split(sql_round("""
WITH m AS (SELECT CAST(l_linestatus AS VARCHAR) AS v, count(*) / (SELECT count(*) FROM ls WHERE _split = 'train') AS f
           FROM ls WHERE _split = 'train' GROUP BY 1)
SELECT _rid, coalesce(m.f, 0.0) AS l_linestatus__frequency FROM ls LEFT JOIN m ON ls.l_linestatus IS NOT DISTINCT FROM m.v""",
                                           ["l_linestatus__frequency"])))
def frequency_encode(spark, sf):
    d = li_split(spark, sf, "l_linestatus")
    return rounded(E.apply_frequency(d, E.fit_frequency(d, ["l_linestatus"])).select("_rid", "l_linestatus__frequency"))


@register("datetime_parts", with_views("""
SELECT _rid, year(o_orderdate)::INTEGER AS o_orderdate__year, month(o_orderdate)::INTEGER AS o_orderdate__month,
       day(o_orderdate)::INTEGER AS o_orderdate__day FROM ord""", "ord"))
def datetime_parts(spark, sf):
    d = view(spark, sf, "ord").select("_rid", "o_orderdate")
    return E.datetime_parts(d, ["o_orderdate"])


@register("datetime_epoch", with_views("""
SELECT _rid, epoch_us(o_orderdate) * 1000 AS o_orderdate FROM ord""", "ord"))
def datetime_epoch(spark, sf):
    return E.datetime_epoch(view(spark, sf, "ord").select("_rid", "o_orderdate"), ["o_orderdate"])


@register("convert_types", with_views(sql_round("""
SELECT _rid, CASE WHEN regexp_matches(o_code, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
                  THEN TRY_CAST(trim(o_code) AS DOUBLE) END AS o_code,
       CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM ord""", ["o_code"]), "ord"))
def convert_types(spark, sf):
    d = view(spark, sf, "ord").select("_rid", "o_code", "o_totalprice")
    return rounded(E.convert_types(d, {"o_code": "numeric", "o_totalprice": "text"}))


@register("target_codes", with_views("""
SELECT _rid, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority FROM ord""", "ord"))
def target_codes(spark, sf):
    return E.target_codes(view(spark, sf, "ord").select("_rid", "o_orderpriority"), "o_orderpriority")


@register("hash_encode", with_views("SELECT _rid, " + ", ".join(
    f"CASE WHEN h % 8 <> {i} THEN 0.0 WHEN (h >> 59) = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS source__hash_{i}" for i in range(8))
    + " FROM (SELECT _rid, ('0x' || substr(md5(coalesce(source, '')), 1, 15))::BIGINT AS h FROM docs)", "docs"))
def hash_encode(spark, sf):
    return E.hash_encode(view(spark, sf, "docs").select("_rid", "source"), ["source"])


# ------------------------------------------------------------------ K-1 … K-3, K-6, K-7, K-9

def _scale_sql(center, scale):
    sel = ", ".join(
        f"(CAST({x} AS DOUBLE) - (SELECT coalesce({center.format(x=x)}, 0) FROM ls WHERE _split = 'train')) / "
        f"(SELECT CASE WHEN coalesce({scale.format(x=x)}, 0) = 0 THEN 1 ELSE {scale.format(x=x)} END FROM ls WHERE _split = 'train') AS {x}"
        for x in NUMS)
    return with_split(sql_round(f"SELECT _rid, _split, {sel} FROM ls", NUMS))


@register("scale_standard", _scale_sql("avg({x})", "stddev_pop({x})"))
def scale_standard(spark, sf):
    d = li_split(spark, sf, *NUMS)
    return rounded(K.apply_scaler(d, K.fit_scaler(d, NUMS, "standard")).select("_rid", "_split", *NUMS))


@register("scale_minmax", _scale_sql("min({x})", "(max({x}) - min({x}))"))
def scale_minmax(spark, sf):
    d = li_split(spark, sf, *NUMS)
    return rounded(K.apply_scaler(d, K.fit_scaler(d, NUMS, "minmax")).select("_rid", "_split", *NUMS))


@register("scale_robust", _scale_sql("quantile_cont({x}, 0.5)", "(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))"))
def scale_robust(spark, sf):
    d = li_split(spark, sf, *NUMS)
    return rounded(K.apply_scaler(d, K.fit_scaler(d, NUMS, "robust")).select("_rid", "_split", *NUMS))


@register("scale_excluded", with_split(sql_round(f"""
SELECT _rid, (l_quantity - (SELECT avg(l_quantity) FROM ls WHERE _split = 'train'))
             / (SELECT stddev_pop(l_quantity) FROM ls WHERE _split = 'train') AS l_quantity,
       l_tax FROM ls""", ["l_quantity", "l_tax"])))
def scale_excluded(spark, sf):
    """K-6: ``l_tax`` is excluded by the plan (skip_scaling) and passes through."""
    d = li_split(spark, sf, "l_quantity", "l_tax", "l_discount")
    return rounded(K.apply_scaler(d, K.fit_scaler(d, ["l_quantity"], "standard")).select("_rid", "l_quantity", "l_tax"))


def _norm_sql(kind):
    xs = ["coalesce(l_quantity, 0)", "l_discount", "coalesce(l_tax, 0)"]
    if kind == "l1":
        tot = " + ".join(f"abs({x})" for x in xs)
    elif kind == "l2":
        tot = "sqrt(" + " + ".join(f"{x} * {x}" for x in xs) + ")"
    else:
        tot = "greatest(" + ", ".join(f"abs({x})" for x in xs) + ")"
    sel = ", ".join(f"{x} / CASE WHEN ({tot}) = 0 THEN 1 ELSE ({tot}) END AS {n}"
                    for x, n in zip(xs, ["l_quantity", "l_discount", "l_tax"]))
    return with_views(sql_round(f"SELECT _rid, {sel} FROM li", ["l_quantity", "l_discount", "l_tax"]), "li")


def _norm_q(kind):
    def q(spark, sf):
        d = view(spark, sf, "li").select("_rid", "l_quantity", "l_discount", "l_tax")
        d = d.fillna(0.0, ["l_quantity", "l_tax"])
        return rounded(K.normalize_rows(d, ["l_quantity", "l_discount", "l_tax"], kind))
    return q


for _k in ("l1", "l2", "max"):
    register(f"normalize_{_k}", _norm_sql(_k))(_norm_q(_k))


_CONST_SRC = "(SELECT *, 'x' AS lang_const, CAST(NULL AS INTEGER) AS all_null FROM docs)"


@register("drop_constant", with_views('SELECT "column" FROM (' + sql_union(
    "SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CAST({c} IS NULL AS INTEGER)) AS k FROM " + _CONST_SRC,
    ["lang", "source", "lang_const", "all_null"]) + ") WHERE k <= 1", "docs"))
def drop_constant(spark, sf):
    d = view(spark, sf, "docs").withColumn("lang_const", F.lit("x")).withColumn("all_null", F.lit(None).cast("int"))
    return K.constant_columns(d, ["lang", "source", "lang_const", "all_null"])


# ------------------------------------------------------------------ K-4, K-5, K-8

@register("scale_quantile")
def scale_quantile(spark, sf):
    d = li_split(spark, sf, "l_extendedprice")
    out = K.apply_quantile(d, K.fit_quantile(d, ["l_extendedprice"]))
    return out.groupBy("_split").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"),
                                     F.avg("l_extendedprice").alias("mean"), F.count(F.lit(1)).alias("n"))


@register("quantile_knots", with_split(sql_round(f"""
SELECT 'l_extendedprice' AS "column", CAST(i - 1 AS BIGINT) AS j, q[i] AS value
FROM (SELECT quantile_cont(l_extendedprice, [{", ".join(f"{j}/999.0" for j in range(1000))}]) AS q FROM ls WHERE _split = 'train'),
     range(1, 1001) t(i)""", ["value"])))
def quantile_knots(spark, sf):
    """K-4: the 1,000 knots that the quantile scaler interpolates between."""
    k = K.fit_quantile(li_split(spark, sf, "l_extendedprice"), ["l_extendedprice"])
    return rounded(k.select("column", F.posexplode("knots").alias("j", "value")).withColumn("j", F.col("j").cast("long")))


@register("scale_power")
def scale_power(spark, sf):
    d = li_split(spark, sf, "l_quantity", "l_extendedprice")
    p = K.fit_power(d, ["l_extendedprice", "l_quantity"])
    return p


@register("yeo_johnson_fixed", with_views(sql_round("""
SELECT _rid, CASE WHEN x >= 0 THEN (power(x + 1, 0.5) - 1) / 0.5 ELSE -(power(1 - x, 1.5) - 1) / 1.5 END AS x
FROM (SELECT _rid, l_extendedprice / 10000 - 4 AS x FROM li)""", ["x"]), "li"))
def yeo_johnson_fixed(spark, sf):
    d = view(spark, sf, "li").select("_rid", (F.col("l_extendedprice") / 10000 - 4).alias("x"))
    return rounded(d.select("_rid", K.yeo_johnson(F.col("x"), 0.5).alias("x")))


@register("pca_reduce")
def pca_reduce(spark, sf):
    e = view(spark, sf, "embeddings")
    cols = [f"e{i}" for i in range(64)]
    wide = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(cols)])
    return K.pca_reduce(wide, cols, k=4)
