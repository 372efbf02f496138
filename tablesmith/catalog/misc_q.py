"""Checked queries: projections and casts, balancing, readiness, joins, reuse,
sources/sinks, normality and the end-to-end stage flow (PF-*, B-*, V-*, J-*, H-*, IO-*, P-8,
P-19, P-21, P-22, P-24, L-2, L-6)."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..functions import types as TY
from ..functions.types import NUMERIC_PATTERN
from ..functions.hashing import sql_hash_int
from ..operators import balance as B
from ..operators import profile as P
from ..operators import ready as V
from ..operators import sample as D
from ..operators import score as Z
from ..plans import column_plan as L
from ..session import checkpoint, ensure_checkpoint_dir
from ..sources import io as IO
from ..sources import store as H
from ..sources.tables import view, with_views
from . import ORACLES, register, rounded, sql_round

T = "l_returnflag"
from .profile_q import LI_ALL, LI_CAT, LI_NUM  # noqa: E402


def _scratch(spark, name):
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{next(tempfile._get_candidate_names())}"


# ------------------------------------------------------------------ PF-3 … PF-12, IO-4

@register("drop_planned_columns", with_views("SELECT _rid, l_quantity, l_discount, l_tax, l_returnflag FROM li", "li"))
def drop_planned_columns(spark, sf):
    d = view(spark, sf, "li").select("_rid", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                                      "l_shipdate")
    return d.drop("l_extendedprice", "l_shipdate")


@register("filter_missing_target", with_views("SELECT _rid, quality FROM docs WHERE quality IS NOT NULL", "docs"))
def filter_missing_target(spark, sf):
    return view(spark, sf, "docs").where(F.col("quality").isNotNull()).select("_rid", "quality")


@register("drop_rows_any_missing", with_views("""
SELECT count(*)::BIGINT AS n FROM li WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL AND l_linestatus IS NOT NULL""", "li"))
def drop_rows_any_missing(spark, sf):
    return view(spark, sf, "li").dropna(subset=["l_quantity", "l_tax", "l_linestatus"]).agg(
        F.count(F.lit(1)).cast("long").alias("n"))


@register("na_tokens", with_views(sql_round("""
SELECT _rid, CASE WHEN trim(o_code) = '?' THEN NULL ELSE CAST(trim(o_code) AS DOUBLE) END AS o_code FROM ord""",
    ["o_code"]), "ord"))
def na_tokens(spark, sf):
    d = view(spark, sf, "ord").select("_rid", "o_code")
    return rounded(TY.apply_na_tokens(d, ["?"]))


@register("safe_numeric", with_views(sql_round("""
SELECT _rid, CASE WHEN regexp_matches(s, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
                  THEN TRY_CAST(trim(s) AS DOUBLE) END AS x
FROM (SELECT _rid, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_totalprice AS VARCHAR) || 'd'
                        WHEN o_orderkey % 7 = 1 THEN ' ' || CAST(o_totalprice AS VARCHAR) || ' '
                        ELSE CAST(o_totalprice AS VARCHAR) END AS s FROM ord)""", ["x"]), "ord"))
def safe_numeric(spark, sf):
    d = view(spark, sf, "ord")
    s = (F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.col("o_totalprice").cast("string"), F.lit("d")))
         .when(F.col("o_orderkey") % 7 == 1, F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit(" ")))
         .otherwise(F.col("o_totalprice").cast("string")))
    return rounded(d.select("_rid", TY.safe_numeric(s).alias("x")))


@register("coerce_all_numeric", with_views(sql_round("""
SELECT _rid, CAST(o_totalprice AS FLOAT) AS o_totalprice, CAST(CASE WHEN trim(o_code) = '?' THEN NULL ELSE o_code END AS FLOAT) AS o_code,
       CAST(NULL AS FLOAT) AS o_orderstatus FROM ord""", ["o_totalprice", "o_code", "o_orderstatus"]), "ord"))
def coerce_all_numeric(spark, sf):
    d = view(spark, sf, "ord").select("_rid", "o_totalprice", "o_code", "o_orderstatus")
    out = d.select("_rid", *[TY.safe_numeric(F.col(x), d.schema[x].dataType).cast("float").alias(x)
                             for x in ["o_totalprice", "o_code", "o_orderstatus"]])
    return rounded(out)


@register("sanitize_floats", with_views(sql_round("""
SELECT _rid, CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS ratio FROM li""", ["ratio"]), "li"))
def sanitize_floats(spark, sf):
    """IEEE ratio with explicit ±Infinity / NaN where the tax is zero, then PF-12."""
    d = view(spark, sf, "li")
    x, y = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    ieee = (F.when(y == 0, F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
                   .otherwise(F.lit(float("nan"))))
            .otherwise(x / y))
    return rounded(TY.sanitize_floats(d.select("_rid", ieee.alias("ratio"))))


@register("align_features", with_views("""
SELECT _rid, coalesce(l_quantity, 0) AS l_quantity, 0 AS unseen_feature, coalesce(l_tax, 0) AS l_tax FROM li""", "li"))
def align_features(spark, sf):
    d = view(spark, sf, "li")
    out = Z.align_features(d, ["l_quantity", "unseen_feature", "l_tax"], keep=["_rid"])
    return out.withColumn("unseen_feature", F.col("unseen_feature").cast("int"))


@register("guard_alignment")
def guard_alignment(spark, sf):
    s = D.split_random(view(spark, sf, "li"), 0.2, 42)
    return Z.guard_alignment(s.where("_split = 'train'"), s.where("_split = 'test'"))


# ------------------------------------------------------------------ J-1, J-2, IO-7

@register("attach_target", with_views("""
SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id""", "docs"))
def attach_target(spark, sf):
    x = view(spark, sf, "documents").select("doc_id", "n_chars")
    y = view(spark, sf, "labels").select("doc_id", "quality")
    return x.join(y, "doc_id", "inner")


@register("rebuild_clean", with_views("SELECT _rid, l_quantity, l_returnflag FROM li", "li"))
def rebuild_clean(spark, sf):
    s = D.split_random(view(spark, sf, "li").select("_rid", "l_quantity", "l_returnflag"), 0.2, 42)
    return IO.rebuild_clean(s.where("_split = 'train'"), s.where("_split = 'test'")).drop("_split")


# ------------------------------------------------------------------ B-1 … B-4, B-7

@register("class_weights", with_views(sql_round("""
WITH c AS (SELECT source, count(*) AS n FROM docs GROUP BY 1)
SELECT source, n::BIGINT AS n, (SELECT max(n) FROM c) / greatest(n, 1) AS class_weight FROM c""", ["class_weight"]), "docs"))
def class_weights(spark, sf):
    d = view(spark, sf, "docs").select("_rid", "source")
    w = B.class_weights(d, "source")
    return rounded(w.groupBy("source").agg(F.count(F.lit(1)).cast("long").alias("n"), F.first("class_weight").alias("class_weight")))


@register("undersample", with_views("""
SELECT _rid, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY ('0x' || substr(md5('42:' || CAST(_rid AS VARCHAR)), 1, 8))::BIGINT, _rid) AS r
                         FROM docs WHERE toxic IS NOT NULL)
WHERE r <= (SELECT min(k) FROM (SELECT count(*) AS k FROM docs WHERE toxic IS NOT NULL GROUP BY toxic))""", "docs"))
def undersample(spark, sf):
    return B.undersample(view(spark, sf, "docs").select("_rid", "toxic"), "toxic")


@register("undersample_guarded", with_views("SELECT _rid, toxic FROM docs", "docs"))
def undersample_guarded(spark, sf):
    """The 0/1 toxic classes are far apart: undersampling would keep < 60 % → no-op."""
    return B.undersample_guarded(view(spark, sf, "docs").select("_rid", "toxic"), "toxic")


@register("undersample_guarded_applies", with_views("""
WITH t AS (SELECT _rid, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN 'a' WHEN doc_id % 5 = 3 OR doc_id % 10 = 9 THEN 'b' END AS k FROM docs),
m AS (SELECT min(n) AS mn FROM (SELECT count(*) AS n FROM t WHERE k IS NOT NULL GROUP BY k))
SELECT _rid, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ('0x' || substr(md5('42:' || CAST(_rid AS VARCHAR)), 1, 8))::BIGINT, _rid) AS r
                     FROM t WHERE k IS NOT NULL), m WHERE r <= mn""", "docs"))
def undersample_guarded_applies(spark, sf):
    """Two classes 2 : 1 and rows without one: the guard looks at the classes only."""
    i = F.col("doc_id")
    d = view(spark, sf, "docs").select("_rid", F.when((i % 5).isin(0, 1, 2), "a").when((i % 5 == 3) | (i % 10 == 9), "b").alias("k"))
    return B.undersample_guarded(d, "k")


@register("oversample", with_views("""
WITH cc AS (SELECT quality, count(*) AS n FROM docs WHERE quality IS NOT NULL GROUP BY quality),
need AS (SELECT quality, n, (SELECT max(n) FROM cc) - n AS need FROM cc),
dr AS (SELECT quality, n, j FROM need, LATERAL (SELECT unnest(range(1, need + 1)) AS j)),
rk AS (SELECT _rid, quality, n_chars, row_number() OVER (PARTITION BY quality ORDER BY ('0x' || substr(md5('42:' || CAST(_rid AS VARCHAR)), 1, 8))::BIGINT, _rid) - 1 AS r FROM docs)
SELECT _rid, quality, n_chars, 0::BIGINT AS _copy FROM docs
UNION ALL
SELECT rk._rid, rk.quality, rk.n_chars, dr.j::BIGINT FROM dr JOIN rk ON dr.quality = rk.quality
     AND rk.r = ('0x' || substr(md5('42:' || dr.quality || ':' || dr.j), 1, 8))::BIGINT % dr.n""", "docs"))
def oversample(spark, sf):
    """Row by row, the rows without a class among them."""
    d = view(spark, sf, "docs").select("_rid", "quality", "n_chars")
    return B.oversample(d, "quality").select("_rid", "quality", "n_chars", "_copy")


@register("balance_report", with_views("""
SELECT 'before' AS stage, CAST(toxic AS VARCHAR) AS class, count(*)::BIGINT AS count FROM docs WHERE toxic IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'after', CAST(toxic AS VARCHAR), (SELECT min(k) FROM (SELECT count(*) AS k FROM docs WHERE toxic IS NOT NULL GROUP BY toxic))::BIGINT
FROM docs WHERE toxic IS NOT NULL GROUP BY 2""", "docs"))
def balance_report(spark, sf):
    d = view(spark, sf, "docs").where(F.col("toxic").isNotNull()).select("_rid", "toxic")
    return B.balance_report(d, B.undersample(d, "toxic"), "toxic")


# ------------------------------------------------------------------ V-1, V-2, P-21, P-24

@register("readiness", with_views("""
SELECT 'l_quantity' AS "column", true AS is_numeric, count(*) FILTER (WHERE l_quantity IS NULL)::BIGINT AS missing,
       0::BIGINT AS infinite, CASE WHEN count(*) FILTER (WHERE l_quantity IS NULL) > 0 THEN 'missing_values' END AS blocker FROM li
UNION ALL SELECT 'l_discount', true, count(*) FILTER (WHERE l_discount IS NULL)::BIGINT, 0::BIGINT,
                 CASE WHEN count(*) FILTER (WHERE l_discount IS NULL) > 0 THEN 'missing_values' END FROM li
UNION ALL SELECT 'l_linestatus', false, count(*) FILTER (WHERE l_linestatus IS NULL)::BIGINT, 0::BIGINT, 'non_numeric' FROM li""", "li"))
def readiness(spark, sf):
    return V.readiness(view(spark, sf, "li").select("_rid", "l_quantity", "l_discount", "l_linestatus", T), T)


@register("readiness_infinite", with_views("""
SELECT 'l_quantity' AS "column", true AS is_numeric, count(*) FILTER (WHERE l_quantity IS NULL AND _rid % 1000 <> 0)::BIGINT AS missing,
       count(*) FILTER (WHERE _rid % 1000 = 0)::BIGINT AS infinite,
       CASE WHEN count(*) FILTER (WHERE l_quantity IS NULL AND _rid % 1000 <> 0) > 0 THEN 'missing_values'
            WHEN count(*) FILTER (WHERE _rid % 1000 = 0) > 0 THEN 'infinite_values' END AS blocker FROM li
UNION ALL SELECT 'l_discount', true, 0::BIGINT, count(*) FILTER (WHERE _rid % 500 = 0)::BIGINT,
                 CASE WHEN count(*) FILTER (WHERE _rid % 500 = 0) > 0 THEN 'infinite_values' END FROM li""", "li"))
def readiness_infinite(spark, sf):
    """PF-11: infinite values of both signs, set by a rule on the row id."""
    d = view(spark, sf, "li").select("_rid", T, F.when(F.col("_rid") % 1000 == 0, float("inf")).otherwise(F.col("l_quantity")).alias("l_quantity"),
                                     F.when(F.col("_rid") % 500 == 0, float("-inf")).otherwise(F.coalesce("l_discount", F.lit(0.0))).alias("l_discount"))
    return V.readiness(d, T)


@register("passthrough_text", with_views("SELECT _rid, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM ord", "ord"))
def passthrough_text(spark, sf):
    """E-5: a column kept as text."""
    from ..operators.encode import passthrough_text as keep
    return keep(view(spark, sf, "ord").select("_rid", "o_orderkey", "o_orderstatus"), ["o_orderkey"])


@register("load_rescued", """
SELECT count(*) + 3 AS n_rows, CAST(3 AS BIGINT) AS n_rescued, CAST(sum(o_orderkey) + 1 AS BIGINT) AS keys,
       CAST(sum(o_custkey) + 9 AS BIGINT) AS customers FROM orders""")
def load_rescued(spark, sf):
    """IO-1: a CSV file in which three rows do not fit the sampled types."""
    root = f"{_scratch(spark, 'untidy')}/orders.csv"
    good = view(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    IO.write_table(good, root, "csv")
    first = good.limit(1).select(F.lit("1").alias("a"), F.explode(F.array(
        F.array(F.lit("1"), F.lit("4"), F.lit("not a price")), F.array(F.lit("seven"), F.lit("5"), F.lit("1.5")),
        F.array(F.lit("x"), F.lit("y"), F.lit("z")))).alias("v"))
    first.select(F.col("v")[0].alias("o_orderkey"), F.col("v")[1].alias("o_custkey"), F.col("v")[2].alias("o_totalprice")) \
        .write.mode("append").option("header", True).csv(root)
    schema = IO.sampled_schema(good.select(*[F.col(x).cast("string") for x in good.columns]))
    d = checkpoint(IO.load_table(spark, root, "csv", schema=schema, rescued=IO.RESCUED))
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(IO.RESCUED).isNotNull()).alias("n_rescued"),
                 F.sum("o_orderkey").alias("keys"), F.sum("o_custkey").alias("customers"))


@register("prep_summary", with_views("""
SELECT count(*)::BIGINT AS rows, 3::BIGINT AS features,
       count(*) FILTER (WHERE r > ceil(n * 0.2))::BIGINT AS train_rows, count(*) FILTER (WHERE r <= ceil(n * 0.2))::BIGINT AS test_rows,
       0::BIGINT AS rows_removed
FROM (SELECT row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || CAST(_rid AS VARCHAR)), 1, 8))::BIGINT, _rid) AS r,
             count(*) OVER () AS n FROM li)""", "li"))
def prep_summary(spark, sf):
    d = D.split_random(view(spark, sf, "li").select("_rid", "l_quantity", "l_discount", "l_tax", T), 0.2, 42)
    return V.prep_summary(d, T)


DIGEST = ["mean", "std", "min", "max", "outlier_ratio", "skewness"]


@register("profile_digest", sql_round(f"""
SELECT "column", mean, std, min, max, CASE WHEN outlier_ratio > 0 THEN outlier_ratio END AS outlier_ratio,
       CASE WHEN abs(skewness) > 1 OR "column" = 'l_extendedprice' THEN skewness END AS skewness
FROM ({ORACLES["numeric_profile"]}) n""", DIGEST))
def profile_digest(spark, sf):
    return rounded(V.profile_digest(view(spark, sf, "li").select("_rid", *LI_ALL), "l_extendedprice"))


def _audit_sql() -> str:
    def stats(src):
        return " UNION ALL ".join(f"""SELECT '{x}' AS c, avg({x}) AS mean, stddev_samp({x}) AS std, min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {src}"""
                                  for x in LI_NUM)

    cells = ", ".join(LI_ALL)
    some = " OR ".join(f"{x} IS NULL" for x in LI_ALL)
    err = "abs(o.{x} - n.{x}) / (abs(n.{x}) + 1e-9) * 100"
    unique = " OR ".join(f"count(DISTINCT {x}) = count(*)" for x in LI_ALL)
    flags = "SELECT '{k}' AS item, ({now}) AS there, ({was}) AS said"
    issues = " UNION ALL ".join(flags.format(k=k, now=q.format(src="li"), was=q.format(src="lineitem")) for k, q in {
        "missing_cells": f"SELECT count(*) > 0 FROM {{src}} WHERE {some}",
        "duplicate_rows": f"SELECT count(*) > (SELECT count(*) FROM (SELECT DISTINCT {cells} FROM {{src}})) FROM {{src}}",
        "unique_columns": f"SELECT {unique} FROM {{src}}"}.items())
    ratio = "SELECT max(k) / min(k) >= 3 FROM (SELECT count(*) AS k FROM {src} GROUP BY l_returnflag)"
    return with_views(sql_round(f"""
WITH o AS ({stats("lineitem")}), n AS ({stats("li")}),
f AS (SELECT n.c AS c, {err.format(x="mean")} AS mean, {err.format(x="std")} AS std, greatest({err.format(x="lo")}, {err.format(x="hi")}) AS range
      FROM o JOIN n ON o.c = n.c),
i AS (SELECT 'n_rows' AS item, ((SELECT count(*) FROM li) = (SELECT count(*) FROM lineitem))::INT::DOUBLE AS value UNION ALL SELECT 'n_columns', 1.0),
u AS ({issues}), v AS (SELECT item, said::INT::DOUBLE AS value FROM u WHERE there),
g AS (SELECT 'task' AS item, 1.0 AS value UNION ALL SELECT 'imbalance', (({ratio.format(src="li")}) = ({ratio.format(src="lineitem")}))::INT::DOUBLE),
e AS (SELECT c || '.mean' AS item, mean AS value FROM f UNION ALL SELECT c || '.std', std FROM f UNION ALL SELECT c || '.range', range FROM f),
t AS (SELECT 'invariant' AS item, avg(value) * 100 AS value FROM i UNION ALL SELECT 'fidelity', greatest(0.0, 100 - avg(value)) FROM e
      UNION ALL SELECT 'coverage', coalesce(avg(value) * 100, 100) FROM v UNION ALL SELECT 'agreement', avg(value) * 100 FROM g)
SELECT 'invariant' AS section, item, value FROM i UNION ALL SELECT 'fidelity', item, value FROM e
UNION ALL SELECT 'coverage', item, value FROM v UNION ALL SELECT 'agreement', item, value FROM g
UNION ALL SELECT 'trust', item, value FROM t UNION ALL SELECT 'trust', 'overall', (SELECT avg(value) FROM t)""", ["value"]), "li")


@register("report_audit", _audit_sql())
def report_audit(spark, sf):
    """P-24: the stored report of the raw table against the table with its gaps and outliers."""
    raw = view(spark, sf, "lineitem").select(*LI_ALL)
    root = _scratch(spark, "stored")
    for name, t in V.report_tables(raw, T).items():
        IO.write_table(t, f"{root}/{name}")
    stored = {k: spark.read.parquet(f"{root}/{k}") for k in ("summary", "numeric", "missing", "distinct", "target")}
    return rounded(V.report_audit(stored, view(spark, sf, "li").select(*LI_ALL), T))


@register("quality_warnings_dynamic")
def quality_warnings_dynamic(spark, sf):
    return rounded(V.quality_warnings(view(spark, sf, "docs"), "quality", static=False))


# ------------------------------------------------------------------ P-8

@register("shapiro_flag")
def shapiro_flag(spark, sf):
    from ..operators.normality import shapiro_flags
    return rounded(shapiro_flags(view(spark, sf, "li"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


# ------------------------------------------------------------------ P-19, L-2, L-6, P-22

@register("evidence_static")
def evidence_static(spark, sf):
    d = view(spark, sf, "ord").select("_rid", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_code",
                                      F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_datestr"))
    return rounded(L.evidence(d, "o_orderstatus", static=True))


def _static_plan(spark, sf):
    from pyspark.sql import types as T_
    d = view(spark, sf, "ord").select("_rid", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_code",
                                      F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("o_cust"),
                                      F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_datestr"))
    ev = L.evidence(d, "o_orderstatus", static=True)
    isnum = {f.name: isinstance(f.dataType, T_.NumericType) for f in d.schema.fields}
    return d, ev, L.default_policy(ev, isnum)


STATIC_COLS = ["o_totalprice", "o_orderpriority", "o_code", "o_cust", "o_datestr"]


def _static_policy_sql() -> str:
    """L-2 over the evidence of the columns above; a date is written as year, month and day here."""
    ev = " UNION ALL ".join(f"""
SELECT '{x}' AS "column", {str(x == "o_totalprice").lower()} AS isnum, count(*) FILTER (WHERE {x} IS NULL) / count(*) AS miss,
       count(DISTINCT {x}) AS uc, count(DISTINCT {x}) / count(*) AS ur,
       count(*) FILTER (WHERE {'true' if x == "o_totalprice" else f"regexp_matches({x}, '{NUMERIC_PATTERN}')"}) / greatest(count({x}), 1) AS np,
       count(*) FILTER (WHERE regexp_matches(CAST({x} AS VARCHAR), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) / greatest(count({x}), 1) AS dp
FROM src""" for x in STATIC_COLS)
    return f"""WITH src AS (SELECT o_totalprice, o_orderpriority, o_code, 'C' || o_custkey AS o_cust, strftime(o_orderdate, '%Y-%m-%d') AS o_datestr FROM ord),
e AS ({ev}), t AS (SELECT *, CASE WHEN NOT isnum AND dp > 0.85 THEN 'datetime' WHEN isnum OR np > 0.85 THEN 'numeric' ELSE 'categorical' END AS type FROM e),
h AS (SELECT *, (type = 'categorical' AND (ur > 0.98 OR (uc > 100 AND ur > 0.9))) OR (type = 'numeric' AND ur > 0.98) AS high FROM t)
SELECT "column", type, miss > 0.6 OR (type = 'categorical' AND ur > 0.99) OR high AS "drop",
       CASE WHEN type = 'numeric' THEN 'median' ELSE 'mode' END AS missing, 'keep' AS outlier,
       CASE WHEN type = 'numeric' THEN 'none' WHEN type = 'categorical' AND uc <= 3 THEN 'onehot' ELSE 'label' END AS encoding,
       false AS skip_scaling, CASE WHEN high THEN 'high_cardinality_drop' ELSE 'default_policy' END AS reason, 'default' AS source, uc, ur FROM h"""


@register("plan_default_static", with_views(f"SELECT * EXCLUDE (uc, ur) FROM ({_static_policy_sql()})", "ord"))
def plan_default_static(spark, sf):
    return _static_plan(spark, sf)[2]


@register("plan_safeguards", with_views(f"""
WITH p AS (SELECT * REPLACE ("drop" OR "column" IN ('o_code', 'o_orderpriority') AS "drop",
             CASE WHEN "column" = 'o_orderpriority' THEN 'onehot' ELSE encoding END AS encoding,
             CASE WHEN "column" IN ('o_code', 'o_orderpriority') THEN 'override' ELSE source END AS source) FROM ({_static_policy_sql()})),
f AS (SELECT *, type IN ('categorical', 'text') AND ur > 0.98 AS forced FROM p),
o AS (SELECT *, "drop" AND NOT forced AS opt, floor(count(*) OVER () * 0.35) AS cap FROM f),
r AS (SELECT *, sum(opt::INT) OVER (ORDER BY "column") AS k FROM o)
SELECT "column", type, CASE WHEN opt AND k > cap THEN false ELSE "drop" OR forced END AS "drop", missing, outlier,
       CASE WHEN encoding = 'onehot' AND uc > 3 THEN 'label' ELSE encoding END AS encoding, skip_scaling,
       CASE WHEN opt AND k > cap THEN 'drop cap reached: kept' WHEN forced THEN 'forced high-cardinality drop' ELSE reason END AS reason, source
FROM r""", "ord"))
def plan_safeguards(spark, sf):
    """L-6: two drops asked for besides the policy's own, of which the cap lets one through."""
    d, ev, pol = _static_plan(spark, sf)
    asked = L.plan_from_rows(spark, [{"column": "o_code", "drop": True}, {"column": "o_orderpriority", "drop": True, "encoding": "onehot"}])
    return L.safeguards(L.merge_plan(pol, asked), ev)


WARNINGS_SQL = f"""
SELECT 'high_missingness' AS type, "column", missing_ratio AS value FROM ({ORACLES["missing_profile"]}) WHERE missing_ratio > 0.5
UNION ALL SELECT 'constant_columns', "column", unique_count FROM ({ORACLES["low_variance"]}) WHERE unique_count <= 1 AND "column" <> '_rid'
UNION ALL SELECT 'high_cardinality_categoricals', "column", unique_count FROM ({ORACLES["low_variance"]})
  WHERE "column" IN ({", ".join(f"'{x}'" for x in LI_CAT)}) AND unique_count > 0.5 * (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'unique_per_row', "column", unique_count FROM ({ORACLES["low_variance"]}) WHERE is_unique_per_row AND "column" <> '_rid'
UNION ALL SELECT 'high_outlier_ratio', "column", outlier_ratio FROM ({ORACLES["numeric_profile"]}) WHERE outlier_ratio > 0.05
UNION ALL SELECT 'non_normal', "column", round(p_value, 6) FROM ({ORACLES["jarque_bera"]}) WHERE NOT is_normal
UNION ALL SELECT 'class_imbalance', 'l_returnflag', x FROM (
  SELECT round(max(count) / min(count), 2) AS x, count(*) AS k FROM ({ORACLES["class_distribution"]})) WHERE k <= 20 AND x >= 3"""


@register("quality_warnings", f"SELECT type, \"column\", CAST(value AS DOUBLE) AS value FROM ({WARNINGS_SQL})")
def quality_warnings(spark, sf):
    return V.quality_warnings(view(spark, sf, "li").select("_rid", *LI_ALL), T)


def _section(name: str, table: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"""SELECT '{name}' AS section, "column", '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {table}""" for m in metrics)


_CORR_SQL = with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0" if a == b else f"round(corr({a}, {b}), 3)") + " AS corr FROM "
    + ("(SELECT 1)" if a == b else "li") for a in LI_NUM for b in LI_NUM), "li")


@register("eda_report", sql_round(f"""
WITH m AS ({ORACLES["missing_profile"]}), v AS ({ORACLES["low_variance"]}), n AS ({ORACLES["numeric_profile"]}),
     c AS ({_CORR_SQL}), t AS ({ORACLES["top_values"]}), d AS ({ORACLES["datetime_range"]}),
     k AS ({ORACLES["class_distribution"]}), w AS ({WARNINGS_SQL}),
r AS ({_section("missing", "m", ["missing_count", "missing_ratio"])}
UNION ALL {_section("low_variance", "(SELECT * FROM v WHERE v.column <> '_rid')", ["unique_count", "top_share", "is_constant", "is_near_constant", "is_unique_per_row"])}
UNION ALL {_section("numeric", "n", ["count", "mean", "std", "min", "max", "q1", "median", "q3", "iqr", "zero_count", "skewness", "kurtosis", "outlier_count", "outlier_ratio"])}
UNION ALL SELECT 'correlation', a, b, CAST(corr AS DOUBLE) FROM c
UNION ALL SELECT 'top_values', "column", value, CAST(count AS DOUBLE) FROM t WHERE "column" <> 'l_shipdate'
UNION ALL SELECT 'datetime', "column", 'min_date', epoch(min_date) FROM d UNION ALL SELECT 'datetime', "column", 'max_date', epoch(max_date) FROM d
UNION ALL SELECT 'classes', 'l_returnflag', class, CAST(count AS DOUBLE) FROM k
UNION ALL SELECT 'warnings', "column", type, CAST(value AS DOUBLE) FROM w)
SELECT * FROM r WHERE value IS NOT NULL""", ["value"]))
def eda_report(spark, sf):
    """P-22: the stage report, every section of it."""
    return rounded(V.report(view(spark, sf, "li"), T, LI_ALL))


# ------------------------------------------------------------------ H-1, H-2, IO-1 … IO-10

@register("fingerprint")
def fingerprint(spark, sf):
    d = view(spark, sf, "orders")
    a = H.fingerprint(d, "o_totalprice")
    b = H.fingerprint(d.repartition(7).orderBy(F.rand(3)), "o_totalprice")
    return a.select("n_rows", "fingerprint").unionByName(b.select("n_rows", "fingerprint")).distinct()


FP_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@register("fingerprint_parts", f"""
WITH h AS (SELECT ('0x' || substr(md5(concat_ws('|', {", ".join(f"coalesce(CAST({x} AS VARCHAR), chr(92) || 'N')" for x in FP_COLS)})), 1, 15))::BIGINT AS h
           FROM orders)
SELECT count(*) AS n_rows, CAST(sum(h::HUGEINT) % 2305843009213693952 AS BIGINT) AS hash_sum, bit_xor(h) AS hash_xor FROM h""")
def fingerprint_parts(spark, sf):
    return H.fingerprint_parts(view(spark, sf, "orders"), FP_COLS)


@register("stage_reuse")
def stage_reuse(spark, sf):
    d = view(spark, sf, "li")
    fp = H.fingerprint(d, T).first()["fingerprint"]
    root = _scratch(spark, "store")
    first, hit1 = H.reuse_or_compute(spark, root, "profile", fp, lambda: P.missing_profile(d))
    second, hit2 = H.reuse_or_compute(spark, root, "profile", fp, lambda: P.missing_profile(d))
    return second.withColumn("first_hit", F.lit(hit1)).withColumn("second_hit", F.lit(hit2))


@register("load_roundtrip", " UNION ALL ".join(
    f"SELECT '{fmt}' AS format, count(*) AS n_rows, 6::BIGINT AS n_columns, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders"
    for fmt in ("csv", "json", "parquet")))
def load_roundtrip(spark, sf):
    d = view(spark, sf, "orders")
    root = _scratch(spark, "io")
    rows = []
    for fmt in ("csv", "json", "parquet"):
        path = IO.write_table(d, f"{root}/orders.{fmt}", fmt)
        back = IO.load_table(spark, path, fmt)
        n = back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").cast("long")).alias("k")).first()
        rows.append((fmt, n["n"], len(back.columns), n["k"]))
    return spark.createDataFrame(rows, "format string, n_rows long, n_columns long, keys long")


@register("split_roundtrip", with_views(f"""
SELECT _rid, CASE WHEN row_number() OVER (ORDER BY {sql_hash_int('_rid', 42)}, _rid) <= (SELECT ceil(count(*) * 0.2) FROM li)
            THEN 'test' ELSE 'train' END AS half, {T} FROM li""", "li"))
def split_roundtrip(spark, sf):
    s = D.split_random(view(spark, sf, "li").select("_rid", "l_quantity", T), 0.2, 42)
    root = _scratch(spark, "splits")
    IO.save_split(s, root, "raw")
    halves = [IO.load_split(spark, root, "raw", h).select("_rid", F.lit(h).alias("half"), T) for h in ("train", "test")]
    return halves[0].unionByName(halves[1])


@register("report_sink", ORACLES["missing_profile"])
def report_sink(spark, sf):
    d = view(spark, sf, "li")
    root = _scratch(spark, "report")
    IO.write_report({"missing": P.missing_profile(d), "summary": P.dataset_summary(d, T)}, root)
    return spark.read.schema("column string, missing_count long, missing_ratio double").json(f"{root}/missing")
