"""Checked queries: evidence, column plans and the preparation flows (P-16 … P-22,
L-1 … L-8, K-11, K-12, V-1, V-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.types import NUMERIC_PATTERN
from ..operators import profile as P
from ..operators import ready as V
from ..plans import column_plan as L
from ..plans import preprocess as PP
from ..session import checkpoint
from ..sources.tables import view, with_views
from . import register, rounded, sql_round, sql_union
from .prep_q import SPLIT_CTE

T = "l_returnflag"
PREP_COLS = ["_rid", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate", T]
EV_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate", "line_id"]


def prep_source(spark, sf):
    """li features plus an identifier-like text column that the plan must drop.  The inspection reads every column
    several times, so the rows and their hashed ids are written once."""
    return checkpoint(view(spark, sf, "li").select(*PREP_COLS, F.concat(F.lit("L"), F.col("_rid").cast("string")).alias("line_id")))


PREP_SRC_SQL = "(SELECT _rid, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate, " \
               "l_returnflag, 'L' || CAST(_rid AS VARCHAR) AS line_id FROM li)"

_DTYPE = {"l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
          "l_linestatus": "string", "l_shipdate": "timestamp_ntz", "line_id": "string", T: "string"}
_NUMERIC = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}


def _evidence_sql(cols=None, distinct=False):
    parts = []
    for x in cols or EV_COLS:
        parsed = f"count({x})" if x in _NUMERIC else (
            f"count(*) FILTER (WHERE regexp_matches(CAST({x} AS VARCHAR), '{NUMERIC_PATTERN}'))"
            if _DTYPE[x] == "string" else "0")
        # one row a value, or one a different value
        seen = f"""SELECT min(_rid) AS _rid, CAST({x} AS VARCHAR) AS v FROM src WHERE {x} IS NOT NULL
                                                   GROUP BY 2 ORDER BY 1, 2""" if distinct else \
            f"""SELECT _rid, CAST({x} AS VARCHAR) AS v FROM src WHERE {x} IS NOT NULL
                                                   ORDER BY _rid"""
        parts.append(f"""SELECT '{x}' AS "column", '{_DTYPE[x]}' AS dtype, count(*) FILTER (WHERE {x} IS NULL)::BIGINT AS missing_count,
  count(*) FILTER (WHERE {x} IS NULL) / count(*) AS missing_ratio, count(DISTINCT {x})::BIGINT AS unique_count,
  count(DISTINCT {x}) / count(*) AS unique_ratio, {parsed} / greatest(count({x}), 1) AS numeric_parse_ratio,
  (SELECT string_agg(v, ',' ORDER BY _rid{", v" if distinct else ""}) FROM ({seen} LIMIT 5)) AS sample_values
FROM src""")
    return "WITH src AS " + PREP_SRC_SQL + "\n" + " UNION ALL ".join(parts)


def _ev_sql_full():
    return with_views(sql_round(_evidence_sql(), ["missing_ratio", "unique_ratio", "numeric_parse_ratio"]), "li")


@register("evidence_dynamic", _ev_sql_full())
def evidence_dynamic(spark, sf):
    return rounded(L.evidence(prep_source(spark, sf), T))


def _context_sql():
    stats = " UNION ALL ".join(f"""SELECT '{x}' AS "column", {f'avg({x}), stddev_samp({x}), skewness({x})' if x in _NUMERIC else ', '.join(['avg(NULL::DOUBLE)'] * 3)}
FROM src""" for x in [*EV_COLS, T])
    return with_views(sql_round(f"""WITH ev AS ({_evidence_sql([*EV_COLS, T], distinct=True)}), src AS {PREP_SRC_SQL},
st("column", mean, std, skewness) AS ({stats})
SELECT ev.*, mean, std, skewness, ev.column = '{T}' AS is_target FROM ev JOIN st ON st.column = ev.column""",
        ["missing_ratio", "unique_ratio", "numeric_parse_ratio", "mean", "std", "skewness"]), "li")


@register("preprocessing_context", _context_sql())
def preprocessing_context(spark, sf):
    """P-17: what a planner reads of every column, the target's too: evidence, first different values, moments of numbers."""
    return rounded(L.planner_context(prep_source(spark, sf), T))


@register("evidence_target", with_views(sql_round("""
SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE l_returnflag IS NULL)::BIGINT AS target_missing,
       count(DISTINCT l_returnflag)::BIGINT AS target_unique, 'classification' AS task_type,
       (SELECT max(k) / greatest(min(k), 1) FROM (SELECT count(*) AS k FROM li GROUP BY l_returnflag)) AS imbalance_ratio,
       (SELECT count(*) FROM li) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (_rid) FROM li)) AS duplicate_rows
FROM li""", ["imbalance_ratio"]), "li"))
def evidence_target(spark, sf):
    return rounded(L.target_evidence(view(spark, sf, "li"), T)).withColumn(
        "duplicate_rows", F.col("duplicate_rows").cast("long"))


def _plan_sql():
    return with_views(f"""
WITH ev AS ({_evidence_sql()})
SELECT "column", CASE WHEN numeric_parse_ratio >= 0.9 THEN 'numeric' ELSE 'categorical' END AS type,
       (unique_ratio > 0.95 AND unique_count > 20) AS "drop",
       CASE WHEN numeric_parse_ratio >= 0.9 THEN 'median' ELSE 'mode' END AS missing,
       CASE WHEN numeric_parse_ratio >= 0.9 THEN 'clip_iqr' ELSE 'keep' END AS outlier,
       CASE WHEN numeric_parse_ratio >= 0.9 THEN 'none' WHEN unique_count <= 15 THEN 'onehot' ELSE 'frequency' END AS encoding,
       false AS skip_scaling,
       CASE WHEN unique_ratio > 0.95 AND unique_count > 20 THEN 'nearly every value is different'
            ELSE 'default from the evidence' END AS reason, 'default' AS source
FROM ev""", "li")


@register("plan_default_dynamic", _plan_sql())
def plan_default_dynamic(spark, sf):
    return L.default_plan(L.evidence(prep_source(spark, sf), T))


def _override(spark):
    return L.plan_from_rows(spark, [
        {"column": "l_tax", "missing": "mean", "outlier": "log_transform"},
        {"column": "l_linestatus", "encoding": "label"},
        {"column": "l_discount", "missing": "bogus", "encoding": "sparkle"},
        {"column": "not_a_column", "drop": True},
    ])


def _merged_sql(validated: bool):
    inner = _plan_sql()
    miss = "CASE \"column\" WHEN 'l_tax' THEN 'mean' WHEN 'l_discount' THEN 'bogus' ELSE missing END"
    out = "CASE \"column\" WHEN 'l_tax' THEN 'log_transform' ELSE outlier END"
    enc = "CASE \"column\" WHEN 'l_linestatus' THEN 'label' WHEN 'l_discount' THEN 'sparkle' ELSE encoding END"
    if validated:
        miss = f"CASE WHEN {miss} IN ('mean','median','mode','constant','knn','drop_rows','none') THEN {miss} ELSE missing END"
        enc = f"CASE WHEN {enc} IN ('none','onehot','ordinal','label','frequency') THEN {enc} ELSE encoding END"
    src = "CASE WHEN \"column\" IN ('l_tax', 'l_linestatus', 'l_discount') THEN 'override' ELSE source END"
    return f"""SELECT "column", type, "drop", {miss} AS missing, {out} AS outlier, {enc} AS encoding, skip_scaling,
       reason, {src} AS source FROM ({inner}) p"""


@register("plan_merge", _merged_sql(False))
def plan_merge(spark, sf):
    d = L.default_plan(L.evidence(prep_source(spark, sf), T))
    return L.merge_plan(d, _override(spark))


@register("plan_validate", _merged_sql(True))
def plan_validate(spark, sf):
    d = L.default_plan(L.evidence(prep_source(spark, sf), T))
    return L.validate_plan(L.merge_plan(d, _override(spark)), d)


@register("plan_constraints", f"""SELECT "column", type,
  CASE WHEN "column" = 'line_id' THEN false WHEN "column" = 'l_tax' THEN true ELSE "drop" END AS "drop",
  CASE WHEN "column" = 'l_quantity' THEN 'none' ELSE missing END AS missing, outlier,
  CASE WHEN "column" = 'l_linestatus' AND type <> 'numeric' THEN 'none' ELSE encoding END AS encoding,
  skip_scaling OR "column" = 'l_discount' AS skip_scaling,
  CASE WHEN "column" = 'l_tax' THEN 'Dropped by user constraint' ELSE reason END AS reason,
  CASE WHEN "column" IN ('line_id', 'l_tax', 'l_quantity', 'l_linestatus', 'l_discount') THEN 'constraint' ELSE source END AS source
FROM ({_plan_sql()}) p""")
def plan_constraints(spark, sf):
    d = L.default_plan(L.evidence(prep_source(spark, sf), T))
    cons = spark.createDataFrame([("line_id", "do_not_drop"), ("l_tax", "drop"), ("l_quantity", "leave_missing"),
                                  ("l_linestatus", "do_not_encode"), ("l_discount", "do_not_scale")],
                                 "column string, rule string")
    return L.apply_constraints(d, cons)


@register("constraint_warnings", f"""
SELECT k.column, k.rule, CASE WHEN p.column IS NULL THEN 'unknown column' ELSE 'kept although the plan dropped it' END AS warning
FROM (VALUES ('line_id', 'do_not_drop'), ('l_tax', 'drop'), ('l_tax', 'do_not_drop'), ('no_such', 'drop')) k("column", rule)
LEFT JOIN ({_plan_sql()}) p ON p.column = k.column
WHERE p.column IS NULL OR (k.rule = 'do_not_drop' AND p.drop)""")
def constraint_warnings(spark, sf):
    """L-5: constraints on unknown columns, and columns kept against the plan."""
    cons = spark.createDataFrame([("line_id", "do_not_drop"), ("l_tax", "drop"), ("l_tax", "do_not_drop"), ("no_such", "drop")],
                                 "column string, rule string")
    return L.constraint_warnings(L.default_plan(L.evidence(prep_source(spark, sf), T)), cons)


@register("column_actions", f"""SELECT "column",
  CASE WHEN "drop" THEN 'drop' ELSE concat_ws('+', 'impute:' || missing,
       CASE WHEN outlier <> 'keep' THEN 'outlier:' || outlier END,
       CASE WHEN encoding <> 'none' THEN 'encode:' || encoding END) END AS action,
  reason, source, 'type=' || type || ';skip_scaling=false' AS details
FROM ({_plan_sql()}) p""")
def column_actions(spark, sf):
    return L.column_actions(L.default_plan(L.evidence(prep_source(spark, sf), T)))


# ------------------------------------------------------------------ K-12 flagship

def _prep_sql():
    # l_extendedprice is ~99.7 % unique, so the default plan drops it (identifier rule)
    nums = ["l_quantity", "l_discount", "l_tax"]
    med = ", ".join(f"quantile_cont({x}, 0.5) AS m_{x}" for x in nums)
    imp = ", ".join(f"coalesce({x}, m_{x}) AS {x}" for x in nums)
    fen = ", ".join(f"quantile_cont({x}, 0.25) - 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) AS lo_{x}, "
                    f"quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) AS hi_{x}"
                    for x in nums)
    clp = ", ".join(f"least(greatest({x}, lo_{x}), hi_{x}) AS {x}" for x in nums)
    feats = nums + ["l_linestatus__F", "l_linestatus__O", "l_shipdate__frequency"]
    st = ", ".join(f"avg({x}) AS a_{x}, stddev_pop({x}) AS s_{x}" for x in feats)
    sc = ", ".join(f"({x} - a_{x}) / CASE WHEN coalesce(s_{x}, 0) = 0 THEN 1 ELSE s_{x} END AS {x}" for x in feats)
    body = f"""
tr AS (SELECT * FROM ls WHERE _split = 'train'),
med AS (SELECT {med} FROM tr),
mls AS (SELECT l_linestatus AS v FROM tr WHERE l_linestatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
msd AS (SELECT l_shipdate AS v FROM tr WHERE l_shipdate IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
imp AS (SELECT _rid, _split, l_returnflag, {imp}, coalesce(l_linestatus, (SELECT v FROM mls)) AS l_linestatus,
               coalesce(l_shipdate, (SELECT v FROM msd)) AS l_shipdate FROM ls, med),
fen AS (SELECT {fen} FROM imp WHERE _split = 'train'),
clp AS (SELECT _rid, _split, l_returnflag, {clp}, l_linestatus, l_shipdate FROM imp, fen),
fq AS (SELECT CAST(l_shipdate AS VARCHAR) AS v, count(*) / (SELECT count(*) FROM clp WHERE _split = 'train') AS f
       FROM clp WHERE _split = 'train' GROUP BY 1),
enc AS (SELECT clp._rid, _split, l_returnflag, {", ".join(nums)},
               CAST(coalesce(l_linestatus = 'F', false) AS INTEGER) AS l_linestatus__F,
               CAST(coalesce(l_linestatus = 'O', false) AS INTEGER) AS l_linestatus__O,
               coalesce(fq.f, 0.0) AS l_shipdate__frequency
        FROM clp LEFT JOIN fq ON CAST(clp.l_shipdate AS VARCHAR) IS NOT DISTINCT FROM fq.v),
st AS (SELECT {st} FROM enc WHERE _split = 'train')
SELECT _rid, _split, l_returnflag, {sc} FROM enc, st"""
    inner = f"WITH {SPLIT_CTE},\n{body}"
    return with_views(sql_round(inner, feats), "li")


@register("preprocess_dynamic", _prep_sql())
def preprocess_dynamic(spark, sf):
    """K-12 on lineitem: inspect → plan → split → impute → clip → encode → scale."""
    res = PP.preprocess_dynamic(prep_source(spark, sf), T)
    return rounded(res.data)


@register("preprocess_static")
def preprocess_static(spark, sf):
    """K-11 under the static default policy (safeguards on), with a caller's way for the outliers of each numeric column,
    which the default policy leaves as they are."""
    asked = L.plan_from_rows(spark, [{"column": "l_quantity", "outlier": "clip"}, {"column": "l_extendedprice", "outlier": "clip"},
                                     {"column": "l_discount", "outlier": "drop_rows"}, {"column": "l_tax", "outlier": "log_transform"}])
    res = PP.preprocess_static(prep_source(spark, sf), T, asked=asked)
    return res.data


@register("prep_steps")
def prep_steps(spark, sf):
    res = PP.preprocess_dynamic(prep_source(spark, sf), T)
    return PP.step_status(spark, res)


# ------------------------------------------------------------------ P-16, P-20, P-21

@register("compact_profile", with_views(sql_round("""
SELECT count(*)::BIGINT AS n_rows, 11::BIGINT AS n_columns,
       (count(*) FILTER (WHERE l_quantity IS NULL) + count(*) FILTER (WHERE l_tax IS NULL)
        + count(*) FILTER (WHERE l_linestatus IS NULL) + count(*) FILTER (WHERE l_shipdate IS NULL)) / (count(*) * 11.0) * 100 AS missing_pct,
       count(DISTINCT l_returnflag)::BIGINT AS target_distinct FROM li""", ["missing_pct"]), "li"))
def compact_profile(spark, sf):
    return rounded(V.compact_profile(view(spark, sf, "li"), T))
