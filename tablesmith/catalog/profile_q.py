"""Checked queries: scans, schema, profiles and data quality (IO-2, PF-1/2, P-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.types import columns_of, qcols
from ..operators import profile as P
from ..sources.tables import view, with_views
from . import register, rounded, sql_round, sql_union

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
LI_CAT = ["l_returnflag", "l_linestatus"]
LI_ALL = LI_NUM + LI_CAT + ["l_shipdate"]
LI_CLASS = {**{c: "numeric" for c in LI_NUM}, **{c: "categorical" for c in LI_CAT}, "l_shipdate": "datetime"}


def lv_sql(cols, src="li", as_double=True):
    cast = "CAST({c} AS DOUBLE)" if as_double else "CAST({c} AS VARCHAR)"
    return sql_union(f"SELECT '{{c}}' AS \"column\", {cast} AS value FROM {src} WHERE {{c}} IS NOT NULL", cols)


def freq_sql(cols, src="li"):
    return f"""SELECT "column", value, count(*)::BIGINT AS count FROM ({lv_sql(cols, src, False)}) GROUP BY ALL"""


# ------------------------------------------------------------------ IO-2 / PF-1 / PF-2

@register("schema_extract", with_views(sql_union(
    "SELECT '{c}' AS \"column\", " + "(SELECT count(*) FROM li)::BIGINT AS n_rows, "
    "CASE '{c}' " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(LI_ALL, start=1))
    + " END::INTEGER AS position", LI_ALL), "li"))
def schema_extract(spark, sf):
    df = view(spark, sf, "li")
    n = df.select(F.count(F.lit(1)).cast("long")).scalar()
    return P.column_types(df).select("column", "position", n.alias("n_rows"))


@register("column_types", with_views(sql_union(
    "SELECT '{c}' AS \"column\", CASE '{c}' " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in LI_CLASS.items())
    + " END AS type_class, count({c})::BIGINT AS non_null FROM li", LI_ALL), "li"))
def column_types_q(spark, sf):
    """PF-1/PF-2: classify every column, then select each class and count its values."""
    df = view(spark, sf, "li")
    kinds = P.column_types(df).select("column", "type_class")
    counts = df.agg(*[F.count(F.col(n)).alias(n) for n in LI_ALL]).unpivot([], qcols(LI_ALL), "column", "non_null")
    return kinds.join(counts, "column").select("column", "type_class", F.col("non_null").cast("long"))


# ------------------------------------------------------------------ P-1, P-2

@register("dataset_summary", with_views("""
SELECT count(*)::BIGINT AS n_rows, 11::BIGINT AS n_columns,
       (SELECT count(*) FROM li) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (_rid) FROM li)) AS duplicate_rows,
       'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax' AS numeric_columns,
       'l_returnflag,l_linestatus' AS categorical_columns, 'l_shipdate' AS datetime_columns,
       '' AS boolean_columns, 'l_returnflag' AS target_column, 'string' AS target_dtype
FROM li""", "li"))
def dataset_summary(spark, sf):
    return P.dataset_summary(view(spark, sf, "li"), "l_returnflag").withColumn(
        "duplicate_rows", F.col("duplicate_rows").cast("long"))


@register("duplicate_rows", with_views("""
SELECT sum(k - 1)::BIGINT AS duplicate_rows, sum(k)::BIGINT AS n_rows,
       round(sum(k - 1) / sum(k), 4) AS duplicate_ratio
FROM (SELECT count(*) AS k FROM li_dup GROUP BY ALL_COLS)""".replace(
    "GROUP BY ALL_COLS", "GROUP BY " + ", ".join(LI_ALL)), "li_dup"))
def duplicate_rows_q(spark, sf):
    return P.duplicate_rows(view(spark, sf, "li_dup"), LI_ALL)


# ------------------------------------------------------------------ P-3, P-4

@register("missing_profile", with_views(sql_union(
    "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS missing_count, "
    "round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) AS missing_ratio FROM li", LI_ALL), "li"))
def missing_profile(spark, sf):
    return P.missing_profile(view(spark, sf, "li"), LI_ALL)


@register("distinct_profile", with_views(sql_union(
    "SELECT '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS unique_count, "
    "count(DISTINCT {c}) = count(*) AS is_unique_per_row FROM li", LI_ALL + ["_rid"]), "li"))
def distinct_profile(spark, sf):
    return P.distinct_profile(view(spark, sf, "li"), LI_ALL + ["_rid"])


@register("distinct_profile_approx")
def distinct_profile_approx(spark, sf):
    return P.distinct_profile(view(spark, sf, "li"), LI_ALL + ["_rid"], approx=True)


# ------------------------------------------------------------------ P-5, P-6, P-7

_NUM_SQL = """
WITH lv AS ({lv}),
st AS (SELECT "column", count(value)::BIGINT AS count, avg(value) AS mean, stddev_samp(value) AS std,
              min(value) AS "min", max(value) AS "max", quantile_cont(value, 0.25) AS q1,
              quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3,
              count(*) FILTER (WHERE value = 0)::BIGINT AS zero_count,
              skewness(value) AS skewness, kurtosis(value) AS kurtosis
       FROM lv GROUP BY "column"),
oc AS (SELECT lv."column", count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))::BIGINT AS outlier_count
       FROM lv JOIN st USING ("column") GROUP BY lv."column")
SELECT st.*, q3 - q1 AS iqr, outlier_count, round(outlier_count / greatest(count, 1), 4) AS outlier_ratio
FROM st JOIN oc USING ("column")"""

NUM_DOUBLES = ["mean", "std", '"min"', '"max"', "q1", "median", "q3", "iqr", "skewness", "kurtosis"]


@register("numeric_profile", with_views(sql_round(_NUM_SQL.format(lv=lv_sql(LI_NUM)), NUM_DOUBLES), "li"))
def numeric_profile(spark, sf):
    return rounded(P.numeric_profile(view(spark, sf, "li"), LI_NUM))


@register("skew_kurt", with_views(sql_round(sql_union(
    "SELECT '{c}' AS \"column\", skewness({c}) AS skewness, kurtosis({c}) AS kurtosis FROM li", LI_NUM),
    ["skewness", "kurtosis"]), "li"))
def skew_kurt(spark, sf):
    return rounded(P.numeric_profile(view(spark, sf, "li"), LI_NUM).select("column", "skewness", "kurtosis"))


@register("iqr_outliers", with_views(sql_round(sql_union(
    "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < q1 - 1.5*(q3-q1) OR {c} > q3 + 1.5*(q3-q1))::BIGINT AS outlier_count, "
    "q1 - 1.5*(q3-q1) AS lower_fence, q3 + 1.5*(q3-q1) AS upper_fence "
    "FROM li, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM li) f GROUP BY q1, q3",
    LI_NUM), ["lower_fence", "upper_fence"]), "li"))
def iqr_outliers(spark, sf):
    p = P.numeric_profile(view(spark, sf, "li"), LI_NUM)
    return rounded(p.select("column", "outlier_count", (F.col("q1") - 1.5 * F.col("iqr")).alias("lower_fence"),
                            (F.col("q3") + 1.5 * F.col("iqr")).alias("upper_fence")))


@register("jarque_bera", with_views(sql_round(f"""
SELECT "column", n, jb, exp(-jb / 2) AS p_value, exp(-jb / 2) > 0.05 AS is_normal FROM (
  SELECT "column", count(value)::BIGINT AS n,
         count(value) / 6.0 * (power(skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1)), 2)
           + power((kurtosis(value) * (count(value) - 2) * (count(value) - 3) / (count(value) - 1) - 6) / (count(value) + 1), 2) / 4.0) AS jb
  FROM ({lv_sql(LI_NUM)}) GROUP BY "column")""", ["jb", "p_value"]), "li"))
def jarque_bera(spark, sf):
    return rounded(P.jarque_bera(view(spark, sf, "li"), LI_NUM))


# ------------------------------------------------------------------ P-9, P-10, P-11

@register("top_values", with_views(f"""
SELECT "column", CAST(rank AS INTEGER) AS rank, value, count FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank
  FROM ({freq_sql(LI_CAT + ['l_shipdate'])})) WHERE rank <= 5""", "li"))
def top_values(spark, sf):
    return P.top_values(view(spark, sf, "li"), LI_CAT + ["l_shipdate"], k=5)


@register("datetime_range", with_views("""
SELECT 'l_shipdate' AS "column", min(l_shipdate) AS min_date, max(l_shipdate) AS max_date FROM li""", "li"))
def datetime_range(spark, sf):
    return P.datetime_range(view(spark, sf, "li"), ["l_shipdate"])


# ------------------------------------------------------------------ P-12, P-13, P-14, P-15

@register("low_variance", with_views(f"""
WITH f AS ({freq_sql(LI_ALL + ['_rid'])}),
g AS (SELECT "column", count(*)::BIGINT AS unique_count, max(count) AS top_count FROM f GROUP BY "column"),
n AS (SELECT count(*) AS n FROM li)
SELECT "column", unique_count, round(top_count / n, 4) AS top_share, unique_count <= 1 AS is_constant,
       (unique_count > 1 AND unique_count < n AND top_count / n > 0.95) AS is_near_constant,
       (unique_count = n AND unique_count > 1) AS is_unique_per_row
FROM g, n""", "li"))
def low_variance(spark, sf):
    return P.low_variance(view(spark, sf, "li"), LI_ALL + ["_rid"])


ORD_STR = ["o_orderstatus", "o_orderpriority", "o_code"]


@register("mixed_parse_classes", with_views(f"""
WITH k AS (SELECT "column", CASE
    WHEN regexp_matches(value, '^\\s*[+-]?\\d+\\s*$') THEN 'int'
    WHEN regexp_matches(value, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN 'float'
    WHEN regexp_matches(value, '^\\s*\\d{{1,4}}[-/]\\d{{1,2}}[-/]\\d{{1,4}}') THEN 'date'
    ELSE 'text' END AS k FROM ({lv_sql(ORD_STR, 'ord', False)}))
SELECT "column", count(*) FILTER (WHERE k = 'int')::BIGINT AS n_int, count(*) FILTER (WHERE k = 'float')::BIGINT AS n_float,
       count(*) FILTER (WHERE k = 'date')::BIGINT AS n_date, count(*) FILTER (WHERE k = 'text')::BIGINT AS n_text,
       CAST(count(DISTINCT k) AS INTEGER) AS n_classes, count(DISTINCT k) > 1 AS is_mixed
FROM k GROUP BY "column" """, "ord"))
def mixed_parse_classes(spark, sf):
    return P.mixed_parse_classes(view(spark, sf, "ord"), ORD_STR)


@register("feature_scale", with_views(sql_round(f"""
WITH s AS ({sql_union("SELECT '{c}' AS \"column\", stddev_samp({c}) AS std, kurtosis({c}) AS kurtosis FROM li",
                      [c for c in LI_NUM if c != 'l_quantity'])}),
m AS (SELECT quantile_cont(std, 0.5) AS med FROM s)
SELECT "column", std, kurtosis, std > 10 * med AS is_wide_scale, abs(kurtosis) > 3 AS is_heavy_tailed,
       (std > 0.5 AND std < 5) AS is_approx_standard FROM s, m""", ["std", "kurtosis"]), "li"))
def feature_scale(spark, sf):
    df = view(spark, sf, "li").drop("l_quantity")
    return rounded(P.feature_scale(df, target=None))
