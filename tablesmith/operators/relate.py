"""Target analysis, relationships and signal strength (T-*, R-*, S-*).

Correlations of all pairs come from one scan (``gram``).  Group statistics are ``groupBy(target)`` aggregates
that return one row per class.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import log2, rnd, safe_corr, sample_kurtosis, sample_skewness
from ..functions.types import NUMERIC_PATTERN, c, columns_of, safe_numeric, qcols
from .gram import correlations, gram
from .quantiles import quantile_table



# ------------------------------------------------------------------ T-1, T-4

def infer_task(df: DataFrame, target: str, max_classes: int = 20, parse_ratio: float = 0.8,
               rule: str = "eda") -> DataFrame:
    """One row (target, parse_ratio, n_distinct, task_type).
    rule 'eda' (T-1): > parse_ratio of values parse and > max_classes distinct → regression;
    rule 'dtype' (T-4): numeric dtype and > max_classes distinct → regression."""
    dt = df.schema[target].dataType
    s = c(target).cast("string")
    parsed = s.rlike(NUMERIC_PATTERN) if not isinstance(dt, T.NumericType) else c(target).isNotNull()
    g = df.where(c(target).isNotNull()).agg(
        (F.sum(parsed.cast("long")) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("parse_ratio"),
        F.count_distinct(c(target)).alias("n_distinct"))
    if rule == "dtype":
        reg = F.lit(isinstance(dt, T.NumericType)) & (F.col("n_distinct") > max_classes)
    else:
        reg = (F.col("parse_ratio") > parse_ratio) & (F.col("n_distinct") > max_classes)
    return g.select(F.lit(target).alias("target"), "parse_ratio", F.col("n_distinct").cast("long"),
                    F.when(reg, "regression").otherwise("classification").alias("task_type"))


# ------------------------------------------------------------------ T-2, T-3

def target_regression(df: DataFrame, target: str, quantiles: str = "exact") -> DataFrame:
    """One row of regression-target statistics (T-2)."""
    y = safe_numeric(c(target), df.schema[target].dataType)
    d = df.select(y.alias("y")).where(F.col("y").isNotNull())
    q = quantile_table(d, ["y"], [0.25, 0.75], quantiles)
    q1 = q.where(F.col("p") == 0.25).select("value").scalar()
    q3 = q.where(F.col("p") == 0.75).select("value").scalar()
    iqr = q3 - q1
    g = d.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"),
              F.var_samp("y").alias("var"), F.min("y").alias("min"), F.max("y").alias("max"),
              F.skewness("y").alias("g1"), F.kurtosis("y").alias("g2"),
              F.sum(((F.col("y") < q1 - 1.5 * iqr) | (F.col("y") > q3 + 1.5 * iqr)).cast("long")).alias("out"))
    sk = sample_skewness(F.col("g1"), F.col("n"))
    ku = sample_kurtosis(F.col("g2"), F.col("n"))
    return g.select(F.col("n").cast("long"), "mean", "std", "var", "min", "max",
                    (F.col("max") - F.col("min")).alias("range"), sk.alias("skewness"),
                    F.when(F.abs(sk) < 0.5, "low").when(F.abs(sk) < 1, "moderate").otherwise("high").alias("skew_severity"),
                    ku.alias("kurtosis"), (ku > 3).alias("heavy_tailed"),
                    rnd(F.col("out") / F.greatest(F.col("n"), F.lit(1)), 4).alias("outlier_ratio"),
                    (F.col("var") < 1e-3).alias("low_variance"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, count, share) over non-missing target values."""
    cc = df.where(c(target).isNotNull()).groupBy(c(target).cast("string").alias("class")) \
        .agg(F.count(F.lit(1)).alias("count"))
    n = cc.select(F.sum("count")).scalar()
    return cc.select("class", F.col("count").cast("long"), (F.col("count") / n).alias("share"))


def target_classification(df: DataFrame, target: str) -> DataFrame:
    """One row of class-target statistics (T-3): classes, binary flag, min/max share,
    imbalance = round(max/min, 2), severity, entropy (base 2), min count, rare risk."""
    d = class_distribution(df, target)
    return d.agg(F.count(F.lit(1)).cast("long").alias("n_classes"), (F.count(F.lit(1)) == 2).alias("is_binary"),
                 F.min("share").alias("min_share"), F.max("share").alias("max_share"),
                 rnd(F.max("count") / F.min("count"), 2).alias("imbalance_ratio"),
                 (-F.sum(F.col("share") * log2(F.col("share")))).alias("entropy"),
                 F.min("count").cast("long").alias("min_class_count")) \
        .withColumn("imbalance_severity", F.when(F.col("imbalance_ratio") < 2, "none")
                    .when(F.col("imbalance_ratio") < 5, "moderate").otherwise("severe")) \
        .withColumn("rare_class_risk", F.col("min_share") < 0.05)


# ------------------------------------------------------------------ T-5, T-6, T-7

# Target names of the simple suggester, keyword sets of the scored one.
TARGET_NAMES = {"target", "label", "class", "output", "y", "result", "outcome", "churn", "fraud",
                "default", "survived", "diagnosis", "price", "salary", "revenue"}
ID_KEYWORDS = ["id", "uuid", "vin", "index"]
TARGET_KEYWORDS = ["target", "label", "price", "score", "rating", "outcome"]


def suggest_target_simple(df: DataFrame, max_classes: int = 20) -> DataFrame:
    """T-6: first column whose lower-cased name is a known target name, else the last
    column; task from the distinct count (≤ max_classes numeric → classification)."""
    cols = [x for x in df.columns if not x.startswith("_")]
    pick = next((x for x in cols if x.lower() in TARGET_NAMES), cols[-1])
    nd = df.select(F.count_distinct(c(pick))).scalar()
    numeric = isinstance(df.schema[pick].dataType, T.NumericType)
    task = F.when(F.lit(numeric) & (nd > max_classes), "regression").otherwise("classification")
    return df.sparkSession.range(1).select(F.lit(pick).alias("target"), nd.cast("long").alias("n_distinct"),
                                           task.alias("task_type"))


def suggest_target(df: DataFrame, top: int = 3, id_match: str = "substring") -> DataFrame:
    """T-5/T-7 over the column profile.  Excluded first: id-like names, constant and
    all-unique columns.  Detectors give evidence (binary, missing < 5 %, semantic name,
    3–10 distinct, numeric) or exclusions (missing > 30 %, top share > 95 %, id-like);
    priority: any exclusion → low, binary or semantic name → high, ≥ 2 evidence →
    medium, else low.  Low rows are dropped; order by priority then column position."""
    from pyspark.sql import Window
    from .profile import frequency_table
    cols = [x for x in df.columns if not x.startswith("_")]
    n = df.select(F.count(F.lit(1))).scalar()
    f = frequency_table(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("nd"), F.max("count").alias("top"),
                                                        F.sum("count").alias("nn"))
    miss = df.agg(*[F.sum(c(x).isNull().cast("long")).alias(x) for x in cols]).unpivot([], qcols(cols), "column", "miss")
    meta = df.sparkSession.createDataFrame(
        [(x, i, isinstance(df.schema[x].dataType, T.NumericType)) for i, x in enumerate(cols)],
        "column string, position int, is_numeric boolean")
    j = meta.join(f, "column", "left").join(miss, "column").fillna(0, ["nd", "top", "nn"])
    name = F.lower(F.col("column"))
    if id_match == "token":
        idlike = name.rlike(r"(^|[_\W])(" + "|".join(ID_KEYWORDS) + r")($|[_\W])")
    else:
        idlike = F.lit(False)
        for k in ID_KEYWORDS:
            idlike = idlike | F.instr(name, k).cast("boolean")
    sem = F.lit(False)
    for k in TARGET_KEYWORDS:
        sem = sem | F.instr(name, k).cast("boolean")
    miss_r = F.col("miss") / n
    evidence = [("binary", F.col("nd") == 2), ("low_missing", miss_r < 0.05), ("semantic_name", sem),
                ("categorical_like", (F.col("nd") > 2) & (F.col("nd") <= 10)), ("numeric", F.col("is_numeric"))]
    exclusions = [("high_missing", miss_r > 0.3),
                  ("imbalanced", (F.col("nd") > 1) & (F.col("top") / F.greatest(F.col("nn"), F.lit(1)) > 0.95)),
                  ("id_like", idlike)]
    n_ev = sum((cond.cast("int") for _, cond in evidence), F.lit(0))
    excluded = F.lit(False)
    for _, cond in exclusions:
        excluded = excluded | cond
    pri = (F.when(excluded, "low").when((F.col("nd") == 2) | sem, "high").when(n_ev >= 2, "medium").otherwise("low"))
    task = F.when(F.col("nd") == 2, "classification (binary)").when(F.col("nd") <= 10, "classification (multiclass)") \
        .otherwise("regression")
    evid = F.concat_ws(",", *[F.when(cond, F.lit(nm)) for nm, cond in evidence])
    j = j.where(~idlike & (F.col("nd") > 1) & (F.col("nd") != n)) \
        .select("column", "position", pri.alias("priority"), task.alias("task_type"), evid.alias("evidence"))
    order = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    w = Window.orderBy(order, "position")   # over the per-column table
    return (j.where(F.col("priority") != "low").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select(F.col("rank").cast("int").alias("rank"), "column", "priority", "task_type", "evidence"))


# ------------------------------------------------------------------ R-1, R-2, R-3, R-7

def non_constant_numeric(df: DataFrame, target: str | None = None) -> list[str]:
    cols = columns_of(df, "numeric", exclude=[target] if target else None)
    if not cols:
        return []
    sd = df.agg(*[F.stddev_samp(c(x)).alias(x) for x in cols]).first()
    return [x for x in cols if sd[x] is not None and sd[x] > 0]


def corr_long(df: DataFrame, cols: list[str], diagonal: bool = False, varying: bool = False) -> DataFrame:
    """(a, b, corr) for every pair a < b in column order (pairwise-complete rows), from one scan (``gram``).
    ``varying``: columns of one value are left out."""
    rows = []
    if cols:
        m = gram(df, cols)
        r = correlations(m)
        own = [k for k in range(len(cols)) if not varying or not math.isnan(r[k, k])]
        rows = [(cols[i], cols[j], None if math.isnan(r[i, j]) else float(r[i, j])) for i, j in combinations(own, 2)]
        if diagonal:
            rows += [(b, a, v) for a, b, v in rows] + [(cols[k], cols[k], 1.0) for k in own]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def strong_pairs(df: DataFrame, target: str | None = None, threshold: float = 0.5) -> DataFrame:
    """R-1 (≥ 0.5) / R-2 (≥ 0.7): strong pairs among non-constant numeric features."""
    cl = corr_long(df, columns_of(df, "numeric", exclude=[target] if target else None), varying=True)
    return cl.where(F.abs("corr") >= threshold).select(F.col("a").alias("feature_1"), F.col("b").alias("feature_2"),
                                                        rnd(F.col("corr"), 3).alias("correlation"))


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """R-7: full matrix in long form, rounded to 3."""
    out = corr_long(df, cols, diagonal=True) if cols is not None else \
        corr_long(df, columns_of(df, "numeric"), diagonal=True, varying=True)
    return out.select("a", "b", rnd(F.col("corr"), 3).alias("corr"))


def target_corr(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """R-3: corr(feature, numeric target), NULL results dropped, rounded 3."""
    cols = cols if cols is not None else non_constant_numeric(df, target)
    wide = df.agg(*[safe_corr(c(x), c(target)).alias(x) for x in cols])
    return wide.unpivot([], qcols(cols), "feature", "corr").where(F.col("corr").isNotNull()) \
        .select("feature", rnd(F.col("corr"), 3).alias("correlation"))


def linear_signal(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """S-2: abs(Pearson) rounded 3 and the non-linear candidate flag (< 0.3)."""
    cols = cols if cols is not None else columns_of(df, "numeric", exclude=[target])
    y = safe_numeric(c(target), df.schema[target].dataType)
    wide = df.agg(*[safe_corr(safe_numeric(c(x), df.schema[x].dataType), y).alias(x) for x in cols])
    return wide.unpivot([], qcols(cols), "feature", "corr").where(F.col("corr").isNotNull()) \
        .select("feature", rnd(F.abs("corr"), 3).alias("strength"), (F.abs("corr") < 0.3).alias("non_linear_candidate"))


# ------------------------------------------------------------------ R-4, R-5, R-6

def group_means(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    """R-4: (feature, class, mean) rounded 3; one row per class and feature."""
    cols = cols if cols is not None else non_constant_numeric(df, target)
    lv = df.select(c(target).cast("string").alias("class"), *[c(x).cast("double").alias(x) for x in cols]) \
        .unpivot(["class"], qcols(cols), "feature", "value")
    return lv.where(F.col("class").isNotNull()).groupBy("feature", "class") \
        .agg(rnd(F.avg("value"), 3).alias("mean"))


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """R-6 in long form: (x, y, count) for every observed pair."""
    return df.groupBy(c(x).cast("string").alias("x"), c(y).cast("string").alias("y")) \
        .agg(F.count(F.lit(1)).cast("long").alias("count"))


def cramers_v(df: DataFrame, target: str, cols: list[str], max_levels: int = 50) -> DataFrame:
    """R-5: Cramér's V per categorical feature (0 when > 50 levels or degenerate).
    chi² = Σ (o − E)² / E with E = r·c/n over the observed contingency cells plus the
    expected mass of the empty cells (Σ_all E = n)."""
    lv = df.select(c(target).cast("string").alias("y"), *[c(x).cast("string").alias(x) for x in cols]) \
        .unpivot(["y"], qcols(cols), "feature", "x").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    cell = lv.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("o"))
    rows = cell.groupBy("feature", "x").agg(F.sum("o").alias("r"))
    colm = cell.groupBy("feature", "y").agg(F.sum("o").alias("cc"))
    tot = cell.groupBy("feature").agg(F.sum("o").alias("n"), F.count_distinct("x").alias("n_x"),
                                      F.count_distinct("y").alias("n_y"))
    j = cell.join(rows, ["feature", "x"]).join(colm, ["feature", "y"]).join(tot, "feature")
    e = F.col("r") * F.col("cc") / F.col("n")
    # Σ over observed cells of (o−E)²/E, plus Σ over empty cells of E = n − Σ_observed E
    chi = j.groupBy("feature", "n", "n_x", "n_y").agg(
        (F.sum((F.col("o") - e) * (F.col("o") - e) / e) + (F.first("n") - F.sum(e))).alias("chi2"))
    k = F.least("n_x", "n_y") - 1
    v = F.when((F.col("n_x") > max_levels) | (k <= 0), F.lit(0.0)).otherwise(F.sqrt(F.col("chi2") / (F.col("n") * k)))
    base = df.sparkSession.createDataFrame([(x,) for x in cols], "feature string")
    return base.join(chi, "feature", "left").select("feature", rnd(F.coalesce(v, F.lit(0.0)), 3).alias("cramers_v"))


# ------------------------------------------------------------------ S-1

def anova_f(df: DataFrame, target: str, cols: list[str] | None = None, min_rows: int = 50) -> DataFrame:
    """S-1: one-way ANOVA F per numeric feature vs class on complete pairs; F =
    (SSB/(K−1)) / (SSW/(n−K)) from centred group sums; < min_rows rows → skipped;
    SSW = 0 → NULL; rounded 4."""
    cols = cols if cols is not None else columns_of(df, "numeric", exclude=[target])
    lv = df.select(c(target).cast("string").alias("y"), *[c(x).cast("double").alias(x) for x in cols]) \
        .unpivot(["y"], qcols(cols), "feature", "v").where(F.col("v").isNotNull() & F.col("y").isNotNull())
    g = lv.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("nk"), F.avg("v").alias("mk"),
                                       (F.var_pop("v") * F.count(F.lit(1))).alias("ssw_k"))
    t = g.groupBy("feature").agg(F.sum("nk").alias("n"), (F.sum(F.col("mk") * F.col("nk")) / F.sum("nk")).alias("m"),
                                 F.count(F.lit(1)).alias("K"), F.sum("ssw_k").alias("ssw"))
    j = g.join(t, "feature").groupBy("feature", "n", "K", "ssw") \
        .agg(F.sum(F.col("nk") * (F.col("mk") - F.col("m")) * (F.col("mk") - F.col("m"))).alias("ssb"))
    fval = F.try_divide(F.col("ssb") / (F.col("K") - 1), F.col("ssw") / (F.col("n") - F.col("K")))
    return j.where((F.col("n") >= min_rows) & (F.col("K") > 1)) \
        .select("feature", F.when(F.col("ssw") > 0, rnd(fval, 4)).alias("f_score"))
