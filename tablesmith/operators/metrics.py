"""Evaluation metrics as aggregations over a prediction table (X-1 … X-9).

Input: a DataFrame with a label column and a prediction (or score) column.  Everything is
a groupBy over (label, prediction) or over distinct scores — tiny intermediate tables —
so the cost is one scan of the prediction table, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import c, qcols
from .common import prefix_sums


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """X-1."""
    return df.agg(F.avg((c(label) == c(pred)).cast("double")).alias("accuracy"))


def per_class(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """(class, tp, fp, fn, support) from the (label, prediction) count table."""
    cm = df.groupBy(c(label).cast("string").alias("y"), c(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tp = cm.where(F.col("y") == F.col("p")).select(F.col("y").alias("class"), F.col("n").alias("tp"))
    fp = cm.where(F.col("y") != F.col("p")).groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("fp"))
    fn = cm.where(F.col("y") != F.col("p")).groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("fn"))
    sup = cm.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"))
    classes = cm.select(F.col("y").alias("class")).union(cm.select(F.col("p").alias("class"))).distinct()
    return (classes.join(tp, "class", "left").join(fp, "class", "left").join(fn, "class", "left")
            .join(sup, "class", "left").fillna(0, ["tp", "fp", "fn", "support"]))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """X-2: accuracy, weighted precision / recall / F1 and macro F1 (0 for empty classes)."""
    pc = per_class(df, label, pred)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return pc.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                  (F.sum(prec * F.col("support")) / F.sum("support")).alias("precision_weighted"),
                  (F.sum(rec * F.col("support")) / F.sum("support")).alias("recall_weighted"),
                  (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"),
                  F.avg(f1).alias("f1_macro"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """X-3: (label, prediction, count) over the full class grid, zeros included."""
    cm = df.groupBy(c(label).cast("string").alias("label"), c(pred).cast("string").alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("count"))
    classes = cm.select(F.col("label").alias("k")).union(cm.select(F.col("prediction").alias("k"))).distinct()
    # class grid: every label × every prediction value, built by exploding the small class list
    ks = classes.agg(F.array_sort(F.collect_set("k")).alias("ks"))
    g = ks.select(F.explode("ks").alias("label"), "ks").select("label", F.explode("ks").alias("prediction"))
    return g.join(cm, ["label", "prediction"], "left").select("label", "prediction",
                                                              F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def binary_counts(df: DataFrame, label: str = "label", pred: str = "prediction", positive="1") -> DataFrame:
    """X-3 for two classes: tn, fp, fn, tp."""
    y = c(label).cast("string") == str(positive)
    p = c(pred).cast("string") == str(positive)
    return df.agg(F.sum((~y & ~p).cast("long")).alias("tn"), F.sum((~y & p).cast("long")).alias("fp"),
                  F.sum((y & ~p).cast("long")).alias("fn"), F.sum((y & p).cast("long")).alias("tp"))


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """X-4: R² = 1 − SSE/SST, RMSE, MSE, MAE."""
    y, p = c(label).cast("double"), c(pred).cast("double")
    ybar = F.lit(df.select(F.avg(y)).first()[0])     # one number, read once
    g = df.agg(F.sum((y - p) * (y - p)).alias("sse"), F.sum((y - ybar) * (y - ybar)).alias("sst"),
               F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"))
    return g.select((1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"), F.sqrt("mse").alias("rmse"), "mse", "mae")


def _roc_steps(df: DataFrame, label: str, score: str, positive, buckets: int | None) -> DataFrame:
    s = c(score).cast("double")
    if buckets:
        s = F.round(s * buckets) / buckets
    y = (c(label).cast("string") == str(positive)).cast("long")
    g = df.groupBy(s.alias("threshold")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    cum = prefix_sums(g.withColumn("_down", -F.col("threshold")), [], "_down", {"tp0": F.col("pos"), "fp0": F.col("neg")})
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))      # one row
    return cum.crossJoin(F.broadcast(tot)).select(
        "threshold", F.try_divide(F.col("fp0") + F.col("neg"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("tp0") + F.col("pos"), F.col("P")).alias("tpr"),
        F.try_divide(F.col("fp0"), F.col("N")).alias("fpr_before"), F.try_divide(F.col("tp0"), F.col("P")).alias("tpr_before"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", positive=1, buckets: int | None = None) -> DataFrame:
    """X-5: (threshold, fpr, tpr) at every distinct score, descending; with ``buckets``
    scores are rounded to that many quantile-free equal steps first.  The cumulative counts
    are prefix sums over ranges of scores, not a window over all of them."""
    return _roc_steps(df, label, score, positive, buckets).select("threshold", "fpr", "tpr")


def auc(df: DataFrame, label: str = "label", score: str = "score", positive=1, buckets: int | None = None) -> DataFrame:
    """X-5: trapezoid area under the ROC points (starting at (0, 0)); each step knows the point before it."""
    step = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2
    return _roc_steps(df, label, score, positive, buckets).agg(F.sum(step).alias("auc"))


def scores_to_labels(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """X-6: arrays → argmax; probabilities in [0, 1] → > 0.5; other numbers → rint;
    strings kept."""
    from pyspark.sql import types as T
    dt = df.schema[col].dataType
    if isinstance(dt, T.ArrayType):
        e = (F.array_position(c(col), F.array_max(c(col))) - 1).cast("long")
    elif isinstance(dt, T.StringType):
        e = c(col)
    else:
        x = c(col).cast("double")
        mn, mx = df.select(F.min(x)).scalar(), df.select(F.max(x)).scalar()
        e = F.when((mn >= 0) & (mx <= 1), (x > 0.5).cast("long")).otherwise(F.rint(x).cast("long"))
    return df.withColumn(out, e)


def diagnostic_report(df: DataFrame, task: str, label: str = "label", pred: str = "prediction",
                      score: str | None = None) -> DataFrame:
    """X-8: (metric, value) rows from the metric aggregates."""
    if task == "regression":
        m = regression_metrics(df, label, pred)
    else:
        m = classification_metrics(df, label, pred)
    out = m.unpivot([], qcols(m.columns), "metric", "value")
    if score and task != "regression":
        a = auc(df, label, score)
        out = out.unionByName(a.unpivot([], qcols(a.columns), "metric", "value"))
    return out


def model_comparison(df: DataFrame, label: str = "label", pred: str = "prediction",
                     by: list[str] = ("model", "_split")) -> DataFrame:
    """X-9: accuracy and weighted precision / recall / F1 per (model, split)."""
    by = list(by)
    cm = df.groupBy(*[c(b) for b in by], c(label).cast("string").alias("y"), c(pred).cast("string").alias("p")) \
        .agg(F.count(F.lit(1)).alias("n"))
    tp = cm.where(F.col("y") == F.col("p")).select(*by, F.col("y").alias("k"), F.col("n").alias("tp"))
    fp = cm.where(F.col("y") != F.col("p")).groupBy(*by, F.col("p").alias("k")).agg(F.sum("n").alias("fp"))
    fn = cm.where(F.col("y") != F.col("p")).groupBy(*by, F.col("y").alias("k")).agg(F.sum("n").alias("fn"))
    sup = cm.groupBy(*by, F.col("y").alias("k")).agg(F.sum("n").alias("support"))
    ks = cm.select(*by, F.col("y").alias("k")).union(cm.select(*by, F.col("p").alias("k"))).distinct()
    pc = ks.join(tp, by + ["k"], "left").join(fp, by + ["k"], "left").join(fn, by + ["k"], "left") \
        .join(sup, by + ["k"], "left").fillna(0, ["tp", "fp", "fn", "support"])
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return pc.groupBy(*by).agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                               (F.sum(prec * F.col("support")) / F.sum("support")).alias("precision"),
                               (F.sum(rec * F.col("support")) / F.sum("support")).alias("recall"),
                               (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))
