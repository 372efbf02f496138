"""Rows-checked queries: MLlib training, search, scoring, nearest neighbours and the
end-to-end stage flow (M-*, Z-*, J-5, N-8, N-9, B-5, B-6, K-10, E-1c, IO-9, IO-10, H-3).
Model fitting is iterative, so these carry property checks in ``tests/`` instead of a
SQL oracle; ``training_plan`` is a projection and has one."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..functions.hashing import sql_hash_int
from ..operators import knn as NN
from ..operators import sample as D
from ..operators import score as Z
from ..operators import train as M
from ..session import checkpoint, ensure_checkpoint_dir
from ..sources import io as IO
from ..sources.tables import view, with_views
from . import register, rounded, sql_round

DOC_F = ["n_chars", "text_len"]
LI_F = ["l_quantity", "l_discount", "l_tax"]


def _docs(spark, sf):
    d = view(spark, sf, "docs").where(F.col("quality").isNotNull()).select("_rid", *DOC_F, "quality", "toxic", "lang")
    d = checkpoint(d)       # the split reads it several times, and it holds lengths of whole texts
    return D.split_stratified(d, "quality", 0.2, 42)


def _li(spark, sf):
    d = view(spark, sf, "li").select("_rid", *LI_F, "l_extendedprice").fillna(0.0, ["l_quantity", "l_tax"])
    return D.split_random(d, 0.2, 42)


def _scratch(spark, name):
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{next(tempfile._get_candidate_names())}"


@register("train_each_model")
def train_each_model(spark, sf):
    t = M.train_simple(_docs(spark, sf), "quality", DOC_F, "classification",
                       models=("RandomForest", "GradientBoosting", "LogisticRegression"), refit=False)
    return rounded(t.leaderboard)


@register("train_simple")
def train_simple(spark, sf):
    t = M.train_simple(_li(spark, sf), "l_extendedprice", LI_F, "regression",
                       models=("RandomForest", "LinearRegression"))
    return rounded(t.leaderboard.withColumn("best", F.col("model") == F.lit(t.best_name)))


@register("train_search")
def train_search(spark, sf):
    """M-2: 30 sampled trials of each model."""
    return rounded(M.train_search(_docs(spark, sf), "quality", DOC_F, "classification",
                                  models=("RandomForest", "LogisticRegression")).trials)


@register("search_preprocess_model")
def search_preprocess_model(spark, sf):
    """M-3 / K-10: imputer × scaler combos × 2 models, scored by hash folds."""
    d = view(spark, sf, "docs").where(F.col("quality").isNotNull()).select("_rid", *DOC_F, "lang", "quality")
    return rounded(M.search_preprocess_model(d, "quality", DOC_F, ["lang"], "classification"))


@register("train_portfolio")
def train_portfolio(spark, sf):
    return rounded(M.train_portfolio(_docs(spark, sf), "quality", DOC_F, "classification"))


#: characters whose share of a text tells its language in part
LETTERS = "eaniosruäéñçw"


@register("train_gbt_large")
def train_gbt_large(spark, sf):
    """M-5: 100 rounds of softmax trees for a target of four classes, the language, from shares of letters."""
    text = F.coalesce("text", F.lit(""))
    share = [(F.try_divide(F.length(text) - F.length(F.replace(text, F.lit(x), F.lit(""))), F.length(text))).alias(f"f{i}")
             for i, x in enumerate(LETTERS)]
    d = view(spark, sf, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("_rid"), "lang", *share)
    d = checkpoint(d)       # the texts are searched for letters once, not in every pass
    t = M.train_gbt_large(D.split_stratified(d, "lang", 0.2, 42), "lang", [f"f{i}" for i in range(len(LETTERS))],
                          "classification", rounds=100, depth=3)
    return rounded(t.leaderboard)


@register("training_plan", with_views("""
SELECT CASE WHEN count(*) > 700000 THEN 'large' WHEN count(*) > 10000 OR 11 > 20 THEN 'portfolio' ELSE 'simple' END AS approach,
       'RandomForest,GradientBoosting,LogisticRegression' AS models, 180 AS budget, 'balanced' AS preset FROM li""", "li"))
def training_plan(spark, sf):
    from ..operators.ready import compact_profile
    return M.training_plan(compact_profile(view(spark, sf, "li"), "l_returnflag"))


@register("feature_importance")
def feature_importance(spark, sf):
    t = M.train_simple(_li(spark, sf), "l_extendedprice", LI_F, "regression", models=("RandomForest",))
    rows = M.feature_importance(t.model, LI_F)
    return rounded(spark.createDataFrame(rows, "feature string, importance double"))


@register("batch_score")
def batch_score(spark, sf):
    t = M.train_simple(_li(spark, sf), "l_extendedprice", LI_F, "regression", models=("LinearRegression",))
    new = view(spark, sf, "li").select("_rid", "l_quantity", "l_tax", "l_discount", "l_returnflag")
    return rounded(Z.batch_score(new, t.model, LI_F))


@register("model_roundtrip")
def model_roundtrip(spark, sf):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    d = checkpoint(_li(spark, sf))      # the fit and both models read it
    va = VectorAssembler(inputCols=LI_F, outputCol=M.FEATURES)
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression
    pm = Pipeline(stages=[va, LinearRegression(featuresCol=M.FEATURES, labelCol="l_extendedprice")]).fit(
        d.where("_split = 'train'"))
    path = IO.save_model(pm, _scratch(spark, "model"))
    back = PipelineModel.load(path)
    a = pm.transform(d).select("_rid", F.col("prediction").alias("p1"))
    b = back.transform(d).select("_rid", F.col("prediction").alias("p2"))
    return a.join(b, "_rid").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p1") - F.col("p2"))).alias("max_diff"))


SPLIT_02 = f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY {sql_hash_int('_rid', 42)}, _rid) <= (SELECT ceil(count(*) * 0.2) FROM li)
            THEN 'test' ELSE 'train' END AS _split FROM li"""


@register("export_transformed", with_views(f"""
SELECT _rid, _split, coalesce(l_quantity, 0.0) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount, coalesce(l_tax, 0.0) AS l_tax
FROM ({SPLIT_02})""", "li"))
def export_transformed(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    d = _li(spark, sf)
    v = VectorAssembler(inputCols=LI_F, outputCol="vec").transform(d).select("_rid", "_split", "vec")
    root = _scratch(spark, "export")
    IO.export_transformed(v, root, "vec", LI_F)
    return spark.read.parquet(f"{root}/transformed").select("_rid", "_split", *LI_F)


@register("ml_impute_stage")
def ml_impute_stage(spark, sf):
    """N-9: MLlib Imputer (median) as a stage; fitted on train rows."""
    from ..operators.impute import ml_imputer
    d = D.split_random(view(spark, sf, "li").select("_rid", "l_quantity", "l_tax"), 0.2, 42)
    m = ml_imputer(["l_quantity", "l_tax"], "median").fit(d.where("_split = 'train'"))
    return rounded(m.transform(d).select("_rid", "l_quantity_imp", "l_tax_imp"))


@register("ml_onehot_stage", with_views(f"""
WITH s AS (SELECT _rid, _split, coalesce(l_linestatus, 'missing') AS v FROM ({SPLIT_02})),
k AS (SELECT list(v ORDER BY v) AS ks FROM (SELECT DISTINCT v FROM s WHERE _split = 'train'))
SELECT _rid, list_transform(ks, lambda x: CASE WHEN x = v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ohe FROM s, k""", "li"))
def ml_onehot_stage(spark, sf):
    """E-1c: StringIndexer(keep) + OneHotEncoder(dropLast), fitted on train rows → unseen categories are zeros."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from ..operators.encode import ml_onehot_stages
    d = D.split_random(view(spark, sf, "li").select("_rid", "l_linestatus"), 0.2, 42)
    tr = d.where("_split = 'train'")
    m = Pipeline(stages=ml_onehot_stages(["l_linestatus"])).fit(tr.fillna("missing", ["l_linestatus"]))
    out = m.transform(d.fillna("missing", ["l_linestatus"]))
    return out.select("_rid", vector_to_array("l_linestatus__ohe").alias("ohe"))


@register("kfold_cv_folds", with_views(f"""
SELECT quality, _fold, count(*) AS n FROM (
  SELECT quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {sql_hash_int('_rid', 42)}, _rid) - 1) % 5 AS INTEGER) AS _fold
  FROM docs WHERE quality IS NOT NULL) GROUP BY ALL""", "docs"))
def kfold_cv_folds(spark, sf):
    d = view(spark, sf, "docs").where(F.col("quality").isNotNull()).select("_rid", "quality")
    return D.kfold_assign(d, 5, "quality").groupBy("quality", "_fold").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ J-5, N-8, B-5, B-6

def _emb(spark, sf):
    e = view(spark, sf, "embeddings")
    return NN.to_vectors(e.select(F.col("vec_id").alias("_rid"), "label", F.col("embedding").alias("emb")), array_col="emb")


@register("knn_join_lsh", sql_round("""
SELECT id, nb_id, dist, CAST(rank AS INTEGER) AS rank FROM (
  SELECT a.vec_id AS id, b.vec_id AS nb_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY dist, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5""", ["dist"]))
def knn_join_lsh(spark, sf):
    v = _emb(spark, sf).withColumnRenamed("_rid", "id")
    return rounded(NN.knn_join(v, v, k=5))


KNN_COLS = ["n_chars", "text_len", "quality"]
_PRESENT = " + ".join(f"CAST(p.{x} IS NOT NULL AND b.{x} IS NOT NULL AS INTEGER)" for x in KNN_COLS)
_SQUARES = " + ".join(f"coalesce(power(CAST(p.{x} AS DOUBLE) - b.{x}, 2), 0)" for x in KNN_COLS)


def _knn_fill(x: str) -> str:
    return f"""f_{x} AS (SELECT _rid, avg(v) AS v FROM (
  SELECT p._rid, CAST(b.{x} AS DOUBLE) AS v, row_number() OVER (
    PARTITION BY p._rid ORDER BY sqrt(({_SQUARES}) * 3.0 / ({_PRESENT})), b._rid) AS r
  FROM s p JOIN s b ON p.{x} IS NULL AND b.{x} IS NOT NULL AND b._split = 'train' AND ({_PRESENT}) > 0) WHERE r <= 5 GROUP BY _rid)"""


@register("impute_knn_lsh", with_views(sql_round(f"""
WITH s AS (SELECT _rid, {", ".join(KNN_COLS)}, CASE WHEN row_number() OVER (ORDER BY {sql_hash_int('_rid', 42)}, _rid)
             <= (SELECT ceil(count(*) * 0.2) FROM docs) THEN 'test' ELSE 'train' END AS _split FROM docs),
{", ".join(_knn_fill(x) for x in KNN_COLS)}
SELECT _rid, {", ".join(f"coalesce(CAST(s.{x} AS DOUBLE), f_{x}.v, (SELECT avg({x}) FROM s WHERE _split = 'train')) AS {x}" for x in KNN_COLS)}, _split
FROM s {" ".join(f"LEFT JOIN f_{x} USING (_rid)" for x in KNN_COLS)}""", KNN_COLS), "docs"))
def impute_knn_lsh(spark, sf):
    d = D.split_random(view(spark, sf, "docs").select("_rid", "n_chars", "text_len", "quality"), 0.2, 42)
    return rounded(NN.impute_knn(d, KNN_COLS, k=5))


@register("smote_lsh", """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, false AS synthetic, n FROM c UNION ALL
SELECT label, true, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)""")
def smote_lsh(spark, sf):
    out = NN.smote(_emb(spark, sf), "label")
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("adasyn")
def adasyn(spark, sf):
    """B-6 whole: every row's share and number of synthetic rows, and the rows made from it."""
    return rounded(NN.adasyn_samples(_emb(spark, sf), "label"))


@register("adasyn_rows", """
SELECT label, (SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) AS n FROM embeddings GROUP BY label""")
def adasyn_rows(spark, sf):
    """Every class reaches the size of the largest."""
    return NN.adasyn(_emb(spark, sf), "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ H-3, streaming

@register("stages_end_to_end")
def stages_end_to_end(spark, sf):
    from ..plans.stages import run_stages
    res = run_stages(view(spark, sf, "docs").select("_rid", "lang", "source", "n_chars", "text_len", "toxic"), "toxic")
    return res


@register("stream_score")
def stream_score(spark, sf):
    from ..streaming.score_stream import score_stream_once
    return rounded(score_stream_once(spark, sf))
