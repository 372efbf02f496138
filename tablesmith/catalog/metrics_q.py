"""Checked queries: evaluation metrics over prediction tables derived from lineitem (X-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as X
from ..sources.tables import view, with_views
from . import register, rounded, sql_round

# a rule "model": the return flag guessed from the line status (NULL status → 'N')
PRED = "CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END"


def preds(spark, sf):
    d = view(spark, sf, "li")
    return d.select("_rid", F.col("l_returnflag").alias("label"),
                    F.when(F.col("l_linestatus") == "F", "R").otherwise("N").alias("prediction"),
                    F.col("l_discount").alias("score"), F.col("l_extendedprice").alias("y"),
                    (F.coalesce(F.col("l_quantity"), F.lit(25.0)) * 1500.0).alias("yhat"))


@register("metric_accuracy", with_views(sql_round(f"""
SELECT avg(CAST(l_returnflag = {PRED} AS DOUBLE)) AS accuracy FROM li""", ["accuracy"]), "li"))
def metric_accuracy(spark, sf):
    return rounded(X.accuracy(preds(spark, sf)))


_PC = f"""pc AS (
  SELECT k AS class,
         (SELECT count(*) FROM li WHERE l_returnflag = k AND {PRED} = k) AS tp,
         (SELECT count(*) FROM li WHERE l_returnflag <> k AND {PRED} = k) AS fp,
         (SELECT count(*) FROM li WHERE l_returnflag = k AND {PRED} <> k) AS fn,
         (SELECT count(*) FROM li WHERE l_returnflag = k) AS support
  FROM (SELECT DISTINCT l_returnflag AS k FROM li UNION SELECT DISTINCT {PRED} FROM li))"""


@register("metric_f1", with_views(sql_round(f"""
WITH {_PC}
SELECT sum(tp) / sum(support) AS accuracy,
       sum(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END * support) / sum(support) AS precision_weighted,
       sum(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END * support) / sum(support) AS recall_weighted,
       sum(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END * support) / sum(support) AS f1_weighted,
       avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS f1_macro FROM pc""",
    ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro"]), "li"))
def metric_f1(spark, sf):
    return rounded(X.classification_metrics(preds(spark, sf)))


@register("confusion_matrix", with_views(f"""
WITH k AS (SELECT DISTINCT l_returnflag AS k FROM li UNION SELECT DISTINCT {PRED} FROM li)
SELECT a.k AS label, b.k AS prediction,
       (SELECT count(*) FROM li WHERE l_returnflag = a.k AND {PRED} = b.k)::BIGINT AS count
FROM k a, k b""", "li"))
def confusion_matrix(spark, sf):
    return X.confusion_matrix(preds(spark, sf))


@register("binary_counts", with_views(f"""
SELECT count(*) FILTER (WHERE l_returnflag <> 'R' AND {PRED} <> 'R')::BIGINT AS tn,
       count(*) FILTER (WHERE l_returnflag <> 'R' AND {PRED} = 'R')::BIGINT AS fp,
       count(*) FILTER (WHERE l_returnflag = 'R' AND {PRED} <> 'R')::BIGINT AS fn,
       count(*) FILTER (WHERE l_returnflag = 'R' AND {PRED} = 'R')::BIGINT AS tp FROM li""", "li"))
def binary_counts(spark, sf):
    return X.binary_counts(preds(spark, sf), positive="R")


@register("metric_regression", with_views(sql_round("""
WITH p AS (SELECT l_extendedprice AS y, coalesce(l_quantity, 25.0) * 1500.0 AS yhat FROM li)
SELECT 1 - sum((y - yhat) * (y - yhat)) / sum((y - (SELECT avg(y) FROM p)) * (y - (SELECT avg(y) FROM p))) AS r2,
       sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae FROM p""",
    ["r2", "rmse", "mse", "mae"]), "li"))
def metric_regression(spark, sf):
    return rounded(X.regression_metrics(preds(spark, sf), "y", "yhat"))


_ROC = """WITH g AS (SELECT l_discount AS threshold, sum(CAST(l_returnflag = 'R' AS BIGINT)) AS pos,
                  sum(1 - CAST(l_returnflag = 'R' AS BIGINT)) AS neg FROM li GROUP BY 1),
c AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp FROM g),
r AS (SELECT threshold, fp / (SELECT sum(neg) FROM g) AS fpr, tp / (SELECT sum(pos) FROM g) AS tpr FROM c)"""


@register("roc_curve", with_views(sql_round(_ROC + "\nSELECT * FROM r", ["threshold", "fpr", "tpr"]), "li"))
def roc_curve(spark, sf):
    return rounded(X.roc_curve(preds(spark, sf), "label", "score", positive="R"))


@register("auc", with_views(sql_round(_ROC + """
SELECT sum((fpr - coalesce(pf, 0)) * (tpr + coalesce(pt, 0)) / 2) AS auc FROM (
  SELECT fpr, tpr, lag(fpr) OVER (ORDER BY threshold DESC) AS pf, lag(tpr) OVER (ORDER BY threshold DESC) AS pt FROM r)""",
    ["auc"]), "li"))
def auc(spark, sf):
    return rounded(X.auc(preds(spark, sf), "label", "score", positive="R"))


@register("scores_to_labels", with_views("""
SELECT _rid, CASE WHEN l_discount > 0.5 THEN 1 ELSE 0 END::BIGINT AS label_prob,
       CAST(round(l_quantity) AS BIGINT) AS label_num FROM li""".replace(
    "CAST(round(l_quantity) AS BIGINT)", "CAST(round_even(l_quantity, 0) AS BIGINT)"), "li"))
def scores_to_labels(spark, sf):
    d = view(spark, sf, "li").select("_rid", "l_discount", "l_quantity")
    a = X.scores_to_labels(d, "l_discount", "label_prob")
    b = X.scores_to_labels(a, "l_quantity", "label_num")
    return b.select("_rid", "label_prob", "label_num")


@register("diagnostic_report", with_views(sql_round(f"""
WITH {_PC}
SELECT 'accuracy' AS metric, sum(tp) / sum(support) AS value FROM pc
UNION ALL SELECT 'precision_weighted', sum(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END * support) / sum(support) FROM pc
UNION ALL SELECT 'recall_weighted', sum(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END * support) / sum(support) FROM pc
UNION ALL SELECT 'f1_weighted', sum(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END * support) / sum(support) FROM pc
UNION ALL SELECT 'f1_macro', avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) FROM pc""",
    ["value"]), "li"))
def diagnostic_report(spark, sf):
    return rounded(X.diagnostic_report(preds(spark, sf), "classification"))


@register("model_comparison", with_views(sql_round("""
WITH p AS (SELECT 'status_rule' AS model, l_returnflag AS y, CASE WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END AS p,
                  CASE WHEN l_discount >= 0.05 THEN 'test' ELSE 'train' END AS _split FROM li
           UNION ALL
           SELECT 'tax_rule', l_returnflag, CASE WHEN l_tax >= 0.04 THEN 'A' ELSE 'N' END,
                  CASE WHEN l_discount >= 0.05 THEN 'test' ELSE 'train' END FROM li),
k AS (SELECT DISTINCT model, _split, y AS k FROM p UNION SELECT DISTINCT model, _split, p FROM p),
pc AS (SELECT k.model, k._split, k.k,
              count(*) FILTER (WHERE p.y = k.k AND p.p = k.k) AS tp, count(*) FILTER (WHERE p.y <> k.k AND p.p = k.k) AS fp,
              count(*) FILTER (WHERE p.y = k.k AND p.p <> k.k) AS fn, count(*) FILTER (WHERE p.y = k.k) AS support
       FROM k JOIN p ON k.model = p.model AND k._split = p._split GROUP BY 1, 2, 3)
SELECT model, _split, sum(tp) / sum(support) AS accuracy,
       sum(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END * support) / sum(support) AS "precision",
       sum(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END * support) / sum(support) AS recall,
       sum(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END * support) / sum(support) AS f1
FROM pc GROUP BY 1, 2""", ["accuracy", '"precision"', "recall", "f1"]), "li"))
def model_comparison(spark, sf):
    d = view(spark, sf, "li")
    split = F.when(F.col("l_discount") >= 0.05, "test").otherwise("train")
    a = d.select(F.lit("status_rule").alias("model"), F.col("l_returnflag").alias("label"),
                 F.when(F.col("l_linestatus") == "F", "R").otherwise("N").alias("prediction"), split.alias("_split"))
    b = d.select(F.lit("tax_rule").alias("model"), F.col("l_returnflag").alias("label"),
                 F.when(F.col("l_tax") >= 0.04, "A").otherwise("N").alias("prediction"), split.alias("_split"))
    return rounded(X.model_comparison(a.unionByName(b)))
