"""Column plans as data (P-17 … P-19, L-1 … L-8).

Evidence is one aggregate pass plus the frequency pass over the table; a plan is a
DataFrame with one row per column built by ``case when`` rules over the evidence.  A
caller-supplied plan table (the place where a human or an external advisor would answer)
is merged over the default per field, validated against the allowed values, and then
user constraints are applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import NUMERIC_PATTERN, c, parse_datetime, type_class
from ..operators.profile import distinct_counts
from ..operators.sample import first_values

# Allowed plan values per field (dynamic plan).
ALLOWED = {
    "missing": ["mean", "median", "mode", "constant", "knn", "drop_rows", "none"],
    "outlier": ["keep", "clip_iqr", "remove_rows", "log_transform"],
    "encoding": ["none", "onehot", "ordinal", "label", "frequency"],
    "scaling": ["none", "standard", "minmax", "robust", "quantile", "power"],
    "normalization": ["none", "l1", "l2", "max"],
    "balancing": ["none", "class_weight", "oversample", "undersample", "smote", "adasyn"],
    "type": ["numeric", "categorical", "datetime", "text"],
}
# Allowed plan values per field (static policy).
ALLOWED_STATIC = {
    "dtype": ["numeric", "categorical", "datetime", "text"],
    "missing": ["median", "mean", "mode", "constant", "indicator"],
    "outlier": ["keep", "clip", "log_transform", "drop_rows"],
    "encoding": ["none", "label", "onehot", "frequency", "hash"],
}

PLAN_SCHEMA = ("column string, type string, drop boolean, missing string, outlier string, "
               "encoding string, skip_scaling boolean, reason string, source string")


def _feature_cols(df: DataFrame, target: str | None) -> list[str]:
    return [n for n in df.columns if n != target and not n.startswith("_")]


def evidence(df: DataFrame, target: str | None, sample_k: int = 5, static: bool = False,
             distinct: bool = False) -> DataFrame:
    """One row per feature column: dtype, missing_count/ratio, unique_count/ratio,
    numeric_parse_ratio, (static) datetime_parse_ratio, sample_values (first k non-null
    values by ``_rid``, different ones with ``distinct``, comma-joined).  P-18; with ``static`` also P-19's parse ratio."""
    cols = _feature_cols(df, target)
    dts = {f.name: f.dataType for f in df.schema.fields}
    n = df.select(F.count(F.lit(1))).scalar()

    def parse_expr(name):
        dt = dts[name]
        if isinstance(dt, T.NumericType):
            return c(name).isNotNull()
        if type_class(dt) in ("datetime", "boolean"):
            return F.lit(False)
        return c(name).cast("string").rlike(NUMERIC_PATTERN)

    aggs = []
    for x in cols:
        aggs += [F.sum(c(x).isNull().cast("long")).alias(f"m|{x}"),
                 F.sum(parse_expr(x).cast("long")).alias(f"p|{x}")]
        if static:
            if isinstance(dts[x], T.StringType):
                aggs.append(F.sum(parse_datetime(c(x)).isNotNull().cast("long")).alias(f"d|{x}"))
    wide = df.agg(*aggs)
    stack = []
    for x in cols:
        dtr = F.col(f"`d|{x}`") if (static and isinstance(dts[x], T.StringType)) else F.lit(0)
        stack.append(F.struct(F.lit(x).alias("column"), F.col(f"`m|{x}`").alias("miss"),
                              F.col(f"`p|{x}`").alias("parsed"), dtr.cast("long").alias("dparsed")))
    long = wide.select(F.explode(F.array(*stack)).alias("s")).select("s.*")
    uniq = distinct_counts(df, cols).select("column", "unique_count")
    first = (first_values(df, cols, sample_k, distinct=distinct)
             .groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))),
                                                              lambda s: s["value"]), ",").alias("sample_values")))
    dtype = F.create_map(*sum([[F.lit(x), F.lit(dts[x].simpleString())] for x in cols], []))
    out = (long.join(uniq, "column", "left").join(first, "column", "left")
           .select("column", dtype[F.col("column")].alias("dtype"),
                   F.col("miss").cast("long").alias("missing_count"),
                   (F.col("miss") / F.greatest(n, F.lit(1))).alias("missing_ratio"),
                   F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"),
                   (F.coalesce("unique_count", F.lit(0)) / F.greatest(n, F.lit(1))).alias("unique_ratio"),
                   (F.col("parsed") / F.greatest(n - F.col("miss"), F.lit(1))).alias("numeric_parse_ratio"),
                   (F.col("dparsed") / F.greatest(n - F.col("miss"), F.lit(1))).alias("datetime_parse_ratio"),
                   F.coalesce("sample_values", F.lit("")).alias("sample_values")))
    if not static:
        out = out.drop("datetime_parse_ratio")
    return out


def planner_context(df: DataFrame, target: str, sample_k: int = 5) -> DataFrame:
    """P-17: ``evidence`` of every column and the target, with the first ``sample_k`` different values, mean, std and
    skewness of numbers and is_target."""
    from ..operators.profile import numeric_profile
    ev = evidence(df, None, sample_k, distinct=True)
    moments = numeric_profile(df).select("column", "mean", "std", "skewness")
    return ev.join(moments, "column", "left").withColumn("is_target", F.col("column") == F.lit(target))


def target_evidence(df: DataFrame, target: str, max_classes: int = 20, duplicates: bool = True) -> DataFrame:
    """One row: rows, target missing/unique counts, task type (string or ≤ max_classes
    distinct → classification), class count extremes and imbalance (classification only),
    duplicate rows.  Missing target is a class here."""
    counts = df.groupBy(c(target)).agg(F.count(F.lit(1)).alias("k"))
    is_str = not isinstance(df.schema[target].dataType, T.NumericType)
    g = counts.agg(F.sum("k").alias("rows"),
                   F.sum(F.when(F.col(target).isNull(), F.col("k")).otherwise(0)).alias("target_missing"),
                   F.count(c(target)).alias("target_unique"),
                   F.max("k").alias("max_k"), F.min("k").alias("min_k"))
    cls = F.lit(is_str) | (F.col("target_unique") <= max_classes)
    from ..operators.profile import duplicate_rows
    # the duplicate count is a full-row groupBy (a shuffle of the table); flows that
    # de-duplicate anyway skip it here
    dup = (duplicate_rows(df, [n for n in df.columns if not n.startswith("_")]).select("duplicate_rows").scalar()
           if duplicates else F.lit(None).cast("long"))
    return g.select(F.col("rows").cast("long"), F.col("target_missing").cast("long"),
                    F.col("target_unique").cast("long"),
                    F.when(cls, "classification").otherwise("regression").alias("task_type"),
                    F.when(cls, F.col("max_k") / F.greatest(F.col("min_k"), F.lit(1))).otherwise(F.lit(1.0))
                    .alias("imbalance_ratio"),
                    dup.alias("duplicate_rows"))


# ------------------------------------------------------------------ L-1, L-2

def default_plan(ev: DataFrame) -> DataFrame:
    """L-1: numeric if parse ≥ 0.9; drop if unique ratio > 0.95 and > 20 distinct;
    median/mode; clip_iqr for numeric; onehot ≤ 15 distinct else frequency."""
    numeric = F.col("numeric_parse_ratio") >= 0.9
    high = (F.col("unique_ratio") > 0.95) & (F.col("unique_count") > 20)
    return ev.select(
        "column", F.when(numeric, "numeric").otherwise("categorical").alias("type"), high.alias("drop"),
        F.when(numeric, "median").otherwise("mode").alias("missing"),
        F.when(numeric, "clip_iqr").otherwise("keep").alias("outlier"),
        F.when(numeric, "none").when(F.col("unique_count") <= 15, "onehot").otherwise("frequency").alias("encoding"),
        F.lit(False).alias("skip_scaling"),
        F.when(high, "nearly every value is different").otherwise("default from the evidence").alias("reason"),
        F.lit("default").alias("source"))


def plan_settings(tev: DataFrame, top_k: int = 10) -> DataFrame:
    """Table-level choices of the default plan: scaling, normalisation, balancing, FE."""
    bal = F.when((F.col("task_type") == "classification") & (F.col("imbalance_ratio") >= 2.0), "class_weight") \
        .otherwise("none")
    return tev.select(F.lit("drop").alias("duplicates"), F.lit("standard").alias("scaling"),
                      F.lit("none").alias("normalization"), bal.alias("balancing"),
                      F.lit(top_k).alias("fe_top_k"), F.lit(max(12, top_k * 3)).alias("fe_max_candidates"))


def default_policy(ev: DataFrame, is_numeric_dtype: dict[str, bool], max_onehot: int = 3,
                   hc_ratio: float = 0.98, hc_count: int = 100) -> DataFrame:
    """L-2 (static): numeric if numeric dtype or parse > 0.85; datetime if it holds dates or date
    parse > 0.85 on a non-numeric column; drop if missing > 0.6, text/categorical unique > 0.99,
    or high cardinality; onehot ≤ 3 distinct else label; outliers kept."""
    isnum = F.create_map(*sum([[F.lit(k), F.lit(v)] for k, v in is_numeric_dtype.items()], []))[F.col("column")]
    dates = F.col("dtype").isin("date", "timestamp", "timestamp_ntz") | (F.col("datetime_parse_ratio") > 0.85)
    dtype = (F.when(~isnum & dates, "datetime")
             .when(isnum | (F.col("numeric_parse_ratio") > 0.85), "numeric").otherwise("categorical"))
    e = ev.withColumn("dtype_guess", dtype)
    cat = F.col("dtype_guess").isin("categorical", "text")
    high = (cat & ((F.col("unique_ratio") > hc_ratio) | ((F.col("unique_count") > hc_count) & (F.col("unique_ratio") > 0.9)))) \
        | ((F.col("dtype_guess") == "numeric") & (F.col("unique_ratio") > 0.98))
    drop = (F.col("missing_ratio") > 0.6) | (cat & (F.col("unique_ratio") > 0.99)) | high
    enc = (F.when(F.col("dtype_guess") == "numeric", "none")
           .when((F.col("dtype_guess") == "categorical") & (F.col("unique_count") <= max_onehot), "onehot")
           .otherwise("label"))
    return e.select("column", F.col("dtype_guess").alias("type"), drop.alias("drop"),
                    F.when(F.col("dtype_guess") == "numeric", "median").otherwise("mode").alias("missing"),
                    F.lit("keep").alias("outlier"), enc.alias("encoding"), F.lit(False).alias("skip_scaling"),
                    F.when(high, "high_cardinality_drop").otherwise("default_policy").alias("reason"),
                    F.lit("default").alias("source"))


# ------------------------------------------------------------------ L-3, L-4, L-5

FIELDS = ["type", "drop", "missing", "outlier", "encoding", "skip_scaling", "reason"]


def merge_plan(default: DataFrame, override: DataFrame) -> DataFrame:
    """Per column and field: the override's value when given, else the default's; rows
    for unknown columns are ignored (left join on the default's columns)."""
    o = override.select("column", *[F.col(f).alias(f"o_{f}") for f in FIELDS if f in override.columns])
    j = default.join(o, "column", "left")
    sel = ["column"]
    for f in FIELDS:
        sel.append(F.coalesce(F.col(f"o_{f}"), F.col(f)).alias(f) if f"o_{f}" in j.columns else F.col(f))
    touched = F.lit(False)
    for f in FIELDS:
        if f"o_{f}" in j.columns:
            touched = touched | F.col(f"o_{f}").isNotNull()
    sel.append(F.when(touched, "override").otherwise(F.col("source")).alias("source"))
    return j.select(sel)


def static_policy(ev: DataFrame, is_numeric_dtype: dict[str, bool], asked: DataFrame | None = None) -> DataFrame:
    """The default policy, a caller's over it, each value checked, and the safeguards."""
    pol = default_policy(ev, is_numeric_dtype)
    if asked is not None:
        allowed = {**ALLOWED_STATIC, "type": ALLOWED_STATIC["dtype"]}
        pol = validate_plan(merge_plan(pol, asked), pol, allowed)
    return safeguards(pol, ev)


def validate_plan(plan: DataFrame, default: DataFrame, allowed: dict[str, list[str]] = ALLOWED) -> DataFrame:
    """Replace any value outside the allowed list by the default's value (per field)."""
    d = default.select("column", *[F.col(f).alias(f"d_{f}") for f in ("type", "missing", "outlier", "encoding")])
    j = plan.join(d, "column", "left")
    sel = []
    for f in plan.columns:
        if f in ("type", "missing", "outlier", "encoding") and f in allowed:
            sel.append(F.when(F.lower(F.trim(F.col(f))).isin(allowed[f]), F.lower(F.trim(F.col(f))))
                       .otherwise(F.col(f"d_{f}")).alias(f))
        else:
            sel.append(F.col(f))
    return j.select(sel)


def apply_constraints(plan: DataFrame, constraints: DataFrame, global_no_encode: bool = False) -> DataFrame:
    """constraints(column, rule) with rule in drop, do_not_drop, do_not_encode,
    leave_missing, do_not_scale.  ``do_not_drop`` wins over ``drop``."""
    k = constraints.groupBy("column").agg(*[F.max((F.col("rule") == r).cast("int")).cast("boolean").alias(r)
                                            for r in ("drop", "do_not_drop", "do_not_encode", "leave_missing",
                                                      "do_not_scale")])
    j = plan.join(k.select("column", *[F.col(x).alias(f"k_{x}") for x in k.columns if x != "column"]), "column", "left")
    t = lambda x: F.coalesce(F.col(f"k_{x}"), F.lit(False))
    no_enc = t("do_not_encode") | F.lit(global_no_encode)
    return j.select(
        "column", "type",
        F.when(t("do_not_drop"), False).when(t("drop"), True).otherwise(F.col("drop")).alias("drop"),
        F.when(t("leave_missing"), "none").otherwise(F.col("missing")).alias("missing"),
        "outlier",
        F.when(no_enc & (F.col("type") != "numeric"), "none").otherwise(F.col("encoding")).alias("encoding"),
        (F.col("skip_scaling") | t("do_not_scale")).alias("skip_scaling"),
        F.when(t("drop") & ~t("do_not_drop"), "Dropped by user constraint").otherwise(F.col("reason")).alias("reason"),
        F.when(t("drop") | t("do_not_drop") | t("do_not_encode") | t("leave_missing") | t("do_not_scale"), "constraint")
        .otherwise(F.col("source")).alias("source"))


def constraint_warnings(plan: DataFrame, constraints: DataFrame) -> DataFrame:
    """(column, rule, warning) for constraints naming unknown columns or overriding drops."""
    j = constraints.join(plan.select("column", "drop"), "column", "left")
    return j.select("column", "rule",
                    F.when(F.col("drop").isNull(), "unknown column")
                    .when((F.col("rule") == "do_not_drop") & F.col("drop"), "kept although the plan dropped it")
                    .alias("warning")).where(F.col("warning").isNotNull())


# ------------------------------------------------------------------ L-6, L-8

def safeguards(plan: DataFrame, ev: DataFrame, max_onehot: int = 3, max_drop_share: float = 0.35,
               hc_ratio: float = 0.98) -> DataFrame:
    """Static safeguards: onehot → label above ``max_onehot`` categories; force drop of
    high-cardinality columns; keep optional drops to ≤ 35 % of the features, first by
    column name.  The ranking window runs over the plan table (one row per column)."""
    j = plan.join(ev.select("column", "unique_count", "unique_ratio", "missing_ratio"), "column")
    forced = (F.col("type").isin("categorical", "text")) & (F.col("unique_ratio") > hc_ratio)
    j = j.withColumn("encoding", F.when((F.col("encoding") == "onehot") & (F.col("unique_count") > max_onehot), "label")
                     .otherwise(F.col("encoding")))
    j = j.withColumn("forced", forced).withColumn("drop", F.col("drop") | forced)
    n_feat = F.count(F.lit(1)).over(Window.partitionBy())
    cap = F.floor(n_feat * max_drop_share)
    j = j.withColumn("opt", F.col("drop") & ~F.col("forced"))      # before the cap changes "drop"
    opt = F.col("opt")
    j = j.withColumn("opt_rank", F.sum(opt.cast("int")).over(Window.orderBy("column").rowsBetween(Window.unboundedPreceding, 0)))
    j = j.withColumn("drop", F.when(opt & (F.col("opt_rank") > cap), False).otherwise(F.col("drop")))
    j = j.withColumn("reason", F.when(opt & (F.col("opt_rank") > cap), "drop cap reached: kept")
                     .when(F.col("forced"), "forced high-cardinality drop").otherwise(F.col("reason")))
    return j.select(*plan.columns)


def column_actions(plan: DataFrame) -> DataFrame:
    """One row per column: action, reason, source, details (L-8)."""
    action = (F.when(F.col("drop"), "drop")
              .otherwise(F.concat_ws("+", F.when(F.col("missing") != "none", F.concat(F.lit("impute:"), F.col("missing"))),
                                     F.when(F.col("outlier") != "keep", F.concat(F.lit("outlier:"), F.col("outlier"))),
                                     F.when(F.col("encoding") != "none", F.concat(F.lit("encode:"), F.col("encoding"))))))
    details = F.concat_ws(";", F.concat(F.lit("type="), F.col("type")),
                          F.concat(F.lit("skip_scaling="), F.col("skip_scaling").cast("string")))
    return plan.select("column", F.when(action == "", "keep").otherwise(action).alias("action"), "reason", "source",
                       details.alias("details"))


def plan_from_rows(spark, rows: list[dict]) -> DataFrame:
    """A caller's plan (the place of an external answer) as a DataFrame."""
    cols = ["column"] + FIELDS
    return spark.createDataFrame([tuple(r.get(k) for k in cols) for r in rows],
                                 "column string, type string, drop boolean, missing string, outlier string, "
                                 "encoding string, skip_scaling boolean, reason string")
