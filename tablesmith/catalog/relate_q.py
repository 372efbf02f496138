"""Checked queries: target analysis, relationships, signal and chart data (T-*, R-*, S-*, C-*)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import charts as C
from ..operators import relate as R
from ..sources.tables import view, with_views
from . import register, rounded, sql_round, sql_union

LI_F = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber"]


# ------------------------------------------------------------------ T-1, T-4

@register("task_type", with_views("""
SELECT 'l_returnflag' AS target, 0.0::DOUBLE AS parse_ratio, count(DISTINCT l_returnflag)::BIGINT AS n_distinct,
       'classification' AS task_type FROM li
UNION ALL
SELECT 'o_totalprice', 1.0::DOUBLE, count(DISTINCT o_totalprice)::BIGINT,
       CASE WHEN count(DISTINCT o_totalprice) > 20 THEN 'regression' ELSE 'classification' END FROM ord""", "li", "ord"))
def task_type(spark, sf):
    a = R.infer_task(view(spark, sf, "li"), "l_returnflag")
    b = R.infer_task(view(spark, sf, "ord"), "o_totalprice")
    return a.unionByName(b)


@register("task_type_rules", with_views("""
SELECT 'l_linenumber' AS target, 1.0::DOUBLE AS parse_ratio, count(DISTINCT l_linenumber)::BIGINT AS n_distinct,
       CASE WHEN count(DISTINCT l_linenumber) > 20 THEN 'regression' ELSE 'classification' END AS task_type FROM li
UNION ALL
SELECT 'l_partkey', 1.0::DOUBLE, count(DISTINCT l_partkey)::BIGINT,
       CASE WHEN count(DISTINCT l_partkey) > 20 THEN 'regression' ELSE 'classification' END FROM li""", "li"))
def task_type_rules(spark, sf):
    d = view(spark, sf, "li")
    return R.infer_task(d, "l_linenumber", rule="dtype").unionByName(R.infer_task(d, "l_partkey", rule="dtype"))


# ------------------------------------------------------------------ T-2, T-3

@register("target_regression", with_views(sql_round("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM ord)
SELECT count(o_totalprice)::BIGINT AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std,
       var_samp(o_totalprice) AS var, min(o_totalprice) AS "min", max(o_totalprice) AS "max",
       max(o_totalprice) - min(o_totalprice) AS range, skewness(o_totalprice) AS skewness,
       CASE WHEN abs(skewness(o_totalprice)) < 0.5 THEN 'low' WHEN abs(skewness(o_totalprice)) < 1 THEN 'moderate'
            ELSE 'high' END AS skew_severity,
       kurtosis(o_totalprice) AS kurtosis, kurtosis(o_totalprice) > 3 AS heavy_tailed,
       round(count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1))
             / count(o_totalprice), 4) AS outlier_ratio,
       var_samp(o_totalprice) < 0.001 AS low_variance
FROM ord, q""", ["mean", "std", "var", '"min"', '"max"', "range", "skewness", "kurtosis"]), "ord"))
def target_regression(spark, sf):
    return rounded(R.target_regression(view(spark, sf, "ord"), "o_totalprice"))


@register("target_classification", with_views(sql_round("""
WITH d AS (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS count FROM docs WHERE quality IS NOT NULL GROUP BY 1),
s AS (SELECT *, count / sum(count) OVER () AS share FROM d)
SELECT count(*)::BIGINT AS n_classes, count(*) = 2 AS is_binary, min(share) AS min_share, max(share) AS max_share,
       round(max(count) / min(count), 2) AS imbalance_ratio, -sum(share * log2(share)) AS entropy,
       min(count)::BIGINT AS min_class_count,
       CASE WHEN round(max(count) / min(count), 2) < 2 THEN 'none' WHEN round(max(count) / min(count), 2) < 5
            THEN 'moderate' ELSE 'severe' END AS imbalance_severity,
       min(share) < 0.05 AS rare_class_risk FROM s""", ["min_share", "max_share", "entropy"]), "docs"))
def target_classification(spark, sf):
    return rounded(R.target_classification(view(spark, sf, "docs"), "quality"))


@register("class_distribution", with_views(sql_round("""
SELECT l_returnflag AS class, count(*)::BIGINT AS count, count(*) / sum(count(*)) OVER () AS share
FROM li GROUP BY l_returnflag""", ["share"]), "li"))
def class_distribution(spark, sf):
    return rounded(R.class_distribution(view(spark, sf, "li"), "l_returnflag"))


# ------------------------------------------------------------------ T-5, T-6, T-7

DOC_COLS = ["doc_id", "lang", "source", "n_chars", "text_len", "quality", "toxic"]


@register("suggest_target_simple", with_views("""
SELECT 'toxic' AS target, count(DISTINCT toxic)::BIGINT AS n_distinct, 'classification' AS task_type FROM docs""", "docs"))
def suggest_target_simple(spark, sf):
    return R.suggest_target_simple(view(spark, sf, "docs").select(*DOC_COLS))


def _suggest_sql():
    per = sql_union(
        "SELECT '{c}' AS \"column\", " + "CASE '{c}' " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(DOC_COLS))
        + " END AS position, count(DISTINCT {c}) AS nd, count(*) FILTER (WHERE {c} IS NULL) / count(*) AS mr, "
        "(SELECT max(k) FROM (SELECT count(*) AS k FROM docs WHERE {c} IS NOT NULL GROUP BY {c})) / "
        "greatest(count({c}), 1) AS ts, count(*) AS n FROM docs", DOC_COLS)
    nums = "('doc_id', 'n_chars', 'text_len', 'quality', 'toxic')"
    return with_views(f"""
WITH p AS ({per}),
e AS (SELECT *, (nd = 2) AS ev_bin, (mr < 0.05) AS ev_low, ("column" LIKE '%target%' OR "column" LIKE '%label%' OR
       "column" LIKE '%price%' OR "column" LIKE '%score%' OR "column" LIKE '%rating%' OR "column" LIKE '%outcome%') AS ev_sem,
       (nd > 2 AND nd <= 10) AS ev_cat, "column" IN {nums} AS ev_num,
       (mr > 0.3 OR (nd > 1 AND ts > 0.95)) AS excl
      FROM p WHERE NOT ("column" LIKE '%id%' OR "column" LIKE '%uuid%' OR "column" LIKE '%vin%' OR "column" LIKE '%index%')
        AND nd > 1 AND nd <> n),
r AS (SELECT *, CASE WHEN excl THEN 'low' WHEN ev_bin OR ev_sem THEN 'high'
                     WHEN CAST(ev_bin AS INT) + CAST(ev_low AS INT) + CAST(ev_sem AS INT) + CAST(ev_cat AS INT) + CAST(ev_num AS INT) >= 2
                     THEN 'medium' ELSE 'low' END AS priority FROM e)
SELECT CAST(row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, position) AS INTEGER) AS rank,
       "column", priority,
       CASE WHEN nd = 2 THEN 'classification (binary)' WHEN nd <= 10 THEN 'classification (multiclass)' ELSE 'regression' END AS task_type,
       concat_ws(',', CASE WHEN ev_bin THEN 'binary' END, CASE WHEN ev_low THEN 'low_missing' END,
                 CASE WHEN ev_sem THEN 'semantic_name' END, CASE WHEN ev_cat THEN 'categorical_like' END,
                 CASE WHEN ev_num THEN 'numeric' END) AS evidence
FROM r WHERE priority <> 'low' QUALIFY rank <= 3""", "docs")


@register("suggest_target", _suggest_sql())
def suggest_target(spark, sf):
    return R.suggest_target(view(spark, sf, "docs").select(*DOC_COLS))


# ------------------------------------------------------------------ R-1, R-2, R-3, R-7, S-2

PAIR_F = LI_F + ["l_net"]
PAIR_SRC = "(SELECT *, l_extendedprice * (1 - l_discount) AS l_net FROM li)"


def _pairs_sql(cols, thr):
    parts = [f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r FROM {PAIR_SRC}"
             for a, b in combinations(cols, 2)]
    return with_views("SELECT feature_1, feature_2, round(r, 3) + 0.0 AS correlation FROM (" + " UNION ALL ".join(parts)
                      + f") WHERE abs(r) >= {thr}", "li")


def _pair_view(spark, sf):
    """lineitem features plus the net price, which is correlated with the price by construction."""
    d = view(spark, sf, "li")
    return d.select(*LI_F, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l_net"), "l_returnflag")


@register("strong_pairs", _pairs_sql(PAIR_F, 0.5))
def strong_pairs(spark, sf):
    return R.strong_pairs(_pair_view(spark, sf), "l_returnflag", 0.5)


@register("multicollinearity", _pairs_sql(PAIR_F, 0.7))
def multicollinearity(spark, sf):
    return R.strong_pairs(_pair_view(spark, sf), "l_returnflag", 0.7)


@register("corr_matrix", with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) + 0.0 AS corr FROM li" for a in LI_F for b in LI_F), "li"))
def corr_matrix(spark, sf):
    return R.corr_matrix(view(spark, sf, "li"), LI_F)


TC_F = ["l_quantity", "l_discount", "l_tax", "l_partkey"]


@register("target_corr", with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS feature, round(corr({a}, l_extendedprice), 3) + 0.0 AS correlation FROM li" for a in TC_F), "li"))
def target_corr(spark, sf):
    return R.target_corr(view(spark, sf, "li"), "l_extendedprice", TC_F)


@register("linear_signal", with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS feature, round(abs(corr({a}, l_extendedprice)), 3) AS strength, "
    f"abs(corr({a}, l_extendedprice)) < 0.3 AS non_linear_candidate FROM li" for a in TC_F), "li"))
def linear_signal(spark, sf):
    return R.linear_signal(view(spark, sf, "li"), "l_extendedprice", TC_F)


# ------------------------------------------------------------------ R-4, R-5, R-6, S-1

GM_F = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("group_means", with_views(" UNION ALL ".join(
    f"SELECT '{a}' AS feature, l_returnflag AS class, round(avg({a}), 3) + 0.0 AS mean FROM li GROUP BY l_returnflag"
    for a in GM_F), "li"))
def group_means(spark, sf):
    return R.group_means(view(spark, sf, "li"), "l_returnflag", GM_F)


@register("crosstab", with_views("""
SELECT l_returnflag AS x, l_linestatus AS y, count(*)::BIGINT AS count FROM li GROUP BY 1, 2""", "li"))
def crosstab(spark, sf):
    return R.crosstab(view(spark, sf, "li"), "l_returnflag", "l_linestatus")


def _cramer_sql(src, target, cols):
    parts = []
    for x in cols:
        parts.append(f"""SELECT '{x}' AS feature, (SELECT CASE WHEN count(DISTINCT xx) > 50 OR least(count(DISTINCT xx), count(DISTINCT yy)) <= 1
           THEN 0.0 ELSE sqrt((sum(o * o / (r * cc)) * max(n) - max(n)) / (max(n) * (least(max(nx), max(ny)) - 1))) END
      FROM (SELECT xx, yy, o, sum(o) OVER (PARTITION BY xx) AS r, sum(o) OVER (PARTITION BY yy) AS cc,
                   sum(o) OVER () AS n, count(DISTINCT xx) OVER () AS nx, count(DISTINCT yy) OVER () AS ny
            FROM (SELECT CAST({x} AS VARCHAR) AS xx, CAST({target} AS VARCHAR) AS yy, count(*) AS o FROM {src}
                  WHERE {x} IS NOT NULL AND {target} IS NOT NULL GROUP BY 1, 2))) AS v""")
    return "SELECT feature, round(coalesce(v, 0.0), 3) AS cramers_v FROM (" + " UNION ALL ".join(parts) + ")"


CV_SRC = "(SELECT *, CAST(year(l_shipdate) AS VARCHAR) AS ship_year, CAST(l_linenumber AS VARCHAR) AS line_no FROM li)"


@register("cramers_v", with_views(_cramer_sql(CV_SRC, "l_returnflag", ["l_linestatus", "ship_year", "line_no"]), "li"))
def cramers_v(spark, sf):
    d = view(spark, sf, "li").withColumn("ship_year", F.year("l_shipdate").cast("string")) \
        .withColumn("line_no", F.col("l_linenumber").cast("string"))
    return R.cramers_v(d, "l_returnflag", ["l_linestatus", "ship_year", "line_no"])


def _anova_sql(cols):
    parts = []
    for x in cols:
        parts.append(f"""SELECT '{x}' AS feature, n, k, ssb, ssw FROM (
  SELECT sum(nk) AS n, count(*) AS k, sum(nk * (mk - m) * (mk - m)) AS ssb, sum(ssw_k) AS ssw FROM (
    SELECT g.*, sum(mk * nk) OVER () / sum(nk) OVER () AS m FROM (
      SELECT l_returnflag, count(*) AS nk, avg({x}) AS mk, var_pop({x}) * count(*) AS ssw_k
      FROM li WHERE {x} IS NOT NULL GROUP BY l_returnflag) g) g2) g3""")
    return with_views("SELECT feature, CASE WHEN ssw > 0 THEN round((ssb / (k - 1)) / (ssw / (n - k)), 4) END AS f_score FROM ("
                      + " UNION ALL ".join(parts) + ") u WHERE n >= 50 AND k > 1", "li")


@register("anova_f", _anova_sql(GM_F + ["l_linenumber"]))
def anova_f(spark, sf):
    return R.anova_f(view(spark, sf, "li"), "l_returnflag", GM_F + ["l_linenumber"])


# ------------------------------------------------------------------ C-1 … C-8

@register("chart_missing", with_views(sql_union(
    "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS missing_count, "
    "round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) AS missing_ratio FROM li",
    ["l_quantity", "l_tax", "l_linestatus", "l_shipdate", "l_discount"]).join(["SELECT * FROM (", ") WHERE missing_count > 0"]),
    "li"))
def chart_missing(spark, sf):
    return C.chart_missing(view(spark, sf, "li"), ["l_quantity", "l_tax", "l_linestatus", "l_shipdate", "l_discount"])


def _hist_sql(cols):
    parts = []
    for x in cols:
        parts.append(f"""SELECT '{x}' AS "column", b.bin, lo + b.bin * (hi - lo) / 20 AS lower, lo + (b.bin + 1) * (hi - lo) / 20 AS upper,
       (SELECT count(*) FROM li WHERE {x} IS NOT NULL AND
               least(floor(({x} - lo) / ((hi - lo) / 20)), 19) = b.bin)::BIGINT AS count
FROM (SELECT CASE WHEN max({x}) > min({x}) THEN min({x}) ELSE min({x}) - 0.5 END AS lo,
             CASE WHEN max({x}) > min({x}) THEN max({x}) ELSE max({x}) + 0.5 END AS hi FROM li) m,
     (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b""")
    return with_views(sql_round(" UNION ALL ".join(parts), ["lower", "upper"]), "li")


HIST = ["l_quantity", "l_extendedprice", "l_discount"]


@register("chart_histogram", _hist_sql(HIST))
def chart_histogram(spark, sf):
    return rounded(C.chart_histogram(view(spark, sf, "li"), HIST))


@register("chart_sample", with_views(sql_round(f"""
SELECT "column", _rid, value FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY ('0x' || substr(md5('42:' || CAST(_rid AS VARCHAR)), 1, 8))::BIGINT, _rid) AS r
  FROM ({sql_union("SELECT '{c}' AS \"column\", _rid, CAST({c} AS DOUBLE) AS value FROM li WHERE {c} IS NOT NULL", HIST)}))
WHERE r <= 50""", ["value"]), "li"))
def chart_sample(spark, sf):
    return rounded(C.chart_sample(view(spark, sf, "li"), HIST, 50))


@register("chart_categories", with_views(f"""
SELECT "column", CAST(rank AS INTEGER) AS rank, value, count FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM (
    SELECT "column", value, count(*)::BIGINT AS count FROM ({sql_union(
        "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM ord WHERE {c} IS NOT NULL",
        ["o_orderstatus", "o_orderpriority"])}) GROUP BY 1, 2)) WHERE rank <= 10""", "ord"))
def chart_categories(spark, sf):
    return C.chart_categories(view(spark, sf, "ord"), ["o_orderstatus", "o_orderpriority", "o_code"], 10)


@register("chart_count_hue", with_views("""
SELECT source AS a, lang AS b, count(*)::BIGINT AS count FROM docs
WHERE source IN (SELECT source FROM docs GROUP BY source ORDER BY count(*) DESC, source LIMIT 15) GROUP BY 1, 2""", "docs"))
def chart_count_hue(spark, sf):
    return C.chart_count_hue(view(spark, sf, "docs"), "source", "lang", 15)


@register("chart_box", with_views(sql_round("""
WITH q AS (SELECT l_returnflag AS "group", quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM li GROUP BY 1)
SELECT q.*, (SELECT min(l_extendedprice) FROM li WHERE l_returnflag = q."group" AND l_extendedprice >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
       (SELECT max(l_extendedprice) FROM li WHERE l_returnflag = q."group" AND l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM q""", ["q1", "median", "q3", "whisker_low", "whisker_high"]), "li"))
def chart_box(spark, sf):
    return rounded(C.chart_box(view(spark, sf, "li"), "l_extendedprice", "l_returnflag"))


@register("chart_scatter", with_views(sql_round("""
SELECT _rid, l_quantity AS x, l_extendedprice AS y, l_returnflag AS hue FROM li
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
ORDER BY ('0x' || substr(md5('42:' || CAST(_rid AS VARCHAR)), 1, 8))::BIGINT, _rid LIMIT 1000""", ["x", "y"]), "li"))
def chart_scatter(spark, sf):
    return rounded(C.chart_scatter(view(spark, sf, "li"), "l_quantity", "l_extendedprice", "l_returnflag", 1000))


@register("chart_target", with_views("""
SELECT CAST(toxic AS VARCHAR) AS class, count(*)::BIGINT AS count FROM docs GROUP BY 1""", "docs"))
def chart_target(spark, sf):
    return C.chart_target(view(spark, sf, "docs"), "toxic")
