"""Training, search and leaderboards on Spark MLlib (M-0 … M-7).

Rows never leave the cluster: features are assembled into vectors by
``VectorAssembler``, models are MLlib estimators, scores come from the metric
aggregates in ``metrics``.  The hold-out is the hash-based ``_split`` column and folds
are the hash-based ``_fold`` column, so every result is reproducible and independent of
partitioning.  What runs on the driver is the small loop over models / trials.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import c
from . import metrics as X
from .forest import fit_forest

LABEL = "__label"
FEATURES = "__features"
LARGE = 700_000     # rows of the large path (M-6)


def model_factory(name: str, task: str, params: dict | None = None, n_classes: int = 2, seed: int = 42):
    """M-0 / M-0b: loose name match → MLlib estimator; XGBoost-like names map to GBT;
    unknown → RandomForest."""
    p = dict(params or {})
    n = name.lower().replace("_", "").replace(" ", "")
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    if task == "regression":
        if "linear" in n or "ridge" in n:
            reg = p.pop("regParam", 1.0 if "ridge" in n else 0.0)
            return LinearRegression(regParam=reg, elasticNetParam=0.0, **common, **p)
        if "gradient" in n or "gbt" in n or "gbm" in n or "xgb" in n or "boost" in n:
            return GBTRegressor(seed=seed, **common, **p)
        return RandomForestRegressor(seed=seed, numTrees=p.pop("numTrees", 100), **common, **p)
    if "logistic" in n:
        return LogisticRegression(**common, **p)
    if "gradient" in n or "gbt" in n or "gbm" in n or "xgb" in n or "boost" in n:
        if n_classes > 2:
            return OneVsRest(classifier=GBTClassifier(seed=seed, **p), featuresCol=FEATURES, labelCol=LABEL)
        return GBTClassifier(seed=seed, **common, **p)
    return RandomForestClassifier(seed=seed, numTrees=p.pop("numTrees", 100), **common, **p)


def prepare(df: DataFrame, target: str, features: list[str], task: str) -> tuple[DataFrame, PipelineModel]:
    """Label indexing (classification) + vector assembly, fitted on train rows.  Missing features are 0, as
    when scoring (``score.align_features``); rows without a class, or with one that no train row has, are left out."""
    df = df.withColumns({x: F.coalesce(F.when(~F.isnan(c(x).cast("double")), c(x).cast("double")), F.lit(0.0)) for x in features})
    stages = []
    if task == "classification":
        stages.append(StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc",
                                    handleInvalid="skip"))
    stages.append(VectorAssembler(inputCols=features, outputCol=FEATURES))
    tr = df.where(F.col("_split") == "train") if "_split" in df.columns else df
    src = df if task == "classification" else df.withColumn(LABEL, c(target).cast("double"))
    pm = Pipeline(stages=stages).fit(tr if task == "classification" else tr.withColumn(LABEL, c(target).cast("double")))
    return pm.transform(src), pm


def score_predictions(pred: DataFrame, task: str) -> float:
    """Accuracy (classification) or R² (regression) of a prediction table."""
    if task == "regression":
        return X.regression_metrics(pred, LABEL, "prediction").first()["r2"]
    return X.accuracy(pred, LABEL, "prediction").first()["accuracy"]


def fit_on(est, data: DataFrame, rows: int):
    """The estimator's model.  From ``LARGE`` rows on a forest of numbers is grown on histograms, with the estimator's trees
    and depth: MLlib keeps a weight for every row and tree and passes over all of them for each level."""
    if isinstance(est, RandomForestRegressor) and rows > LARGE:
        return fit_forest(data, LABEL, FEATURES, est.getNumTrees(), est.getMaxDepth(), est.getMaxBins(), est.getSeed())
    return est.fit(data)


@dataclass
class Trained:
    leaderboard: DataFrame
    best_name: str
    model: object
    assembler: PipelineModel
    features: list


def train_simple(df: DataFrame, target: str, features: list[str], task: str,
                 models=("RandomForest", "GradientBoosting", "LogisticRegression"), refit: bool = True) -> Trained:
    """M-1: fit each model on train, score on the hash hold-out, refit the best on all rows."""
    from ..session import checkpoint

    data, pm = prepare(df, target, features, task)
    data = checkpoint(data.select(LABEL, FEATURES, "_split"))       # every fit and score reads it several times
    tr = data.where(F.col("_split") == "train")
    te = data.where(F.col("_split") == "test")
    k = tr.select(F.count_distinct(LABEL)).first()[0] if task == "classification" else 0
    n = data.count()
    names = list(models) if task == "classification" else [m.replace("LogisticRegression", "LinearRegression") for m in models]
    rows = []
    fitted = {}
    for m in names:
        est = model_factory(m, task, n_classes=k)
        fit = fit_on(est, tr, n)
        fitted[m] = fit
        rows.append((m, float(score_predictions(fit.transform(te), task))))
    spark = df.sparkSession
    lb = spark.createDataFrame(rows, "model string, score double")
    best = max(rows, key=lambda r: r[1])[0]
    model = fit_on(model_factory(best, task, n_classes=k), data, n) if refit else fitted[best]
    return Trained(lb, best, model, pm, features)


# Default search spaces (name → (kind, low, high | choices)); regParam is 1 / C.
SEARCH_SPACES = {
    "RandomForest": {"numTrees": ("int", 50, 300), "maxDepth": ("int", 3, 20)},
    "GradientBoosting": {"maxIter": ("int", 50, 300), "stepSize": ("logfloat", 1e-3, 0.3)},
    "XGBoost": {"maxIter": ("int", 50, 300), "maxDepth": ("int", 3, 12), "stepSize": ("logfloat", 1e-3, 0.3)},
    "LogisticRegression": {"regParam": ("logfloat", 0.1, 1000.0)},
    "LinearRegression": {"regParam": ("logfloat", 0.1, 1000.0)},
}
STARTUP = 10        # random trials before the sampler has something to learn from
DRAWS = 24          # draws from the good trials' density, of which one is tried


def _to_unit(spec: tuple, v) -> float:
    kind, low = spec[0], spec[1]
    if kind == "choice":
        return (low.index(v) + 0.5) / len(low)
    if kind == "logfloat":
        return (math.log(v) - math.log(low)) / (math.log(spec[2]) - math.log(low))
    return (v - low + 0.5) / (spec[2] - low + 1) if kind == "int" else (v - low) / (spec[2] - low)


def _from_unit(spec: tuple, u: float):
    kind, low = spec[0], spec[1]
    if kind == "choice":
        return low[min(len(low) - 1, int(u * len(low)))]
    if kind == "logfloat":
        return math.exp(math.log(low) + u * (math.log(spec[2]) - math.log(low)))
    return min(spec[2], low + int(u * (spec[2] - low + 1))) if kind == "int" else low + u * (spec[2] - low)


def _width(points: list[float]) -> float:
    return max(0.03, 0.25 / math.sqrt(len(points)))


def _density(points: list[float], u: float) -> float:
    """A mixture of the uniform density and a bell at every point."""
    width = _width(points)
    bells = sum(math.exp(-0.5 * ((u - x) / width) ** 2) / (width * math.sqrt(2 * math.pi)) for x in points)
    return (1.0 + bells) / (1 + len(points))


def next_params(space: dict, done: list[tuple[dict, float]], rng: random.Random) -> dict:
    """The next trial: random at first; then, for each parameter, of ``DRAWS`` draws near the best quarter of
    the trials the one where the density of good trials is highest against that of the others."""
    if len(done) < STARTUP:
        return {k: _from_unit(s, rng.random()) for k, s in space.items()}
    ranked = [p for p, _ in sorted(done, key=lambda x: -x[1])]
    cut = math.ceil(len(ranked) / 4)
    out = {}
    for k, s in space.items():
        good, bad = ([_to_unit(s, p[k]) for p in part] for part in (ranked[:cut], ranked[cut:]))
        if s[0] == "choice":        # by how often the good trials have it, each at least once
            out[k] = rng.choice([*s[1], *(p[k] for p in ranked[:cut])])
            continue
        width = _width(good)
        drawn = [rng.random() if rng.random() < 1 / (1 + len(good)) else min(1 - 1e-9, max(0.0, rng.gauss(rng.choice(good), width)))
                 for _ in range(DRAWS)]
        out[k] = _from_unit(s, max(drawn, key=lambda u: _density(good, u) / _density(bad, u)))
    return out


def search(space: dict, score, n_trials: int = 30, seed: str = "42", at_once: int = 5) -> list[tuple[int, dict, float | None, str]]:
    """Trials (number, params, score, error) of ``score(params)``, ``at_once`` at a time; the draws depend on the
    seed and on finished batches only.  A trial that Spark refuses or fails has no score and its error's text."""
    from multiprocessing.pool import ThreadPool

    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    rng, rows = random.Random(seed), []

    def run(p):
        try:
            return float(score(p)), None
        except (Py4JError, PySparkException, ValueError, TypeError) as e:
            return None, str(e).splitlines()[0][:200]

    with ThreadPool(at_once) as pool:
        while len(rows) < n_trials:
            done = [(p, s) for _, p, s, _ in rows if s is not None]
            n = min(at_once, n_trials - len(rows))
            batch = [next_params(space, done if k + 1 < n else [], rng) for k in range(n)]      # the last one explores
            rows += [(len(rows) + k, p, s, e) for k, (p, (s, e)) in enumerate(zip(batch, pool.map(run, batch), strict=True))]
    return rows


@dataclass
class Searched:
    trials: DataFrame       # model, trial, params, score, error
    best_name: str
    best_params: dict
    best_score: float
    model: object           # the best, fitted on all rows
    method: str
    assembler: PipelineModel


DEEP = 5            # from deeper forests on, rows keep their nodes: a number for every row and tree


def kept_nodes(est):
    """A deep forest's estimator that stores the node of each row in each tree, and does not walk from the root again
    for every level.  The model is the same.  The nodes are not written as checkpoints: a lost one is found again by
    one walk of at most ``maxDepth`` steps."""
    if isinstance(est, (RandomForestClassifier, RandomForestRegressor)) and est.getMaxDepth() > DEEP:
        return est.setCacheNodeIds(True).setCheckpointInterval(-1)
    return est


def train_search(df: DataFrame, target: str, features: list[str], task: str,
                 models=("RandomForest", "GradientBoosting"), n_trials: int = 30, seed: int = 42,
                 spaces: dict | None = None) -> Searched:
    """M-2: ``n_trials`` (5 to 100) sampled trials of each model, scored on the hash hold-out; the best is fitted
    again on all rows.  Where every trial fails, the models are tried with their defaults (M-1)."""
    from ..session import checkpoint

    n_trials = max(5, min(n_trials, 100))
    data, pm = prepare(df, target, features, task)
    data = checkpoint(data.select(LABEL, FEATURES, "_split"))       # every trial reads it
    tr, te = data.where(F.col("_split") == "train"), data.where(F.col("_split") == "test")
    k = tr.select(F.count_distinct(LABEL)).first()[0] if task == "classification" else 0
    names = list(models) if task == "classification" else [m.replace("LogisticRegression", "LinearRegression") for m in models]
    rows = []

    def fitted(m, p, on):
        return kept_nodes(model_factory(m, task, p, n_classes=k)).fit(on)

    for name in names:
        space = (spaces or SEARCH_SPACES).get(name, {})
        rows += [(name, *t) for t in search(
            space, lambda p, m=name: score_predictions(fitted(m, p, tr).transform(te), task), n_trials, f"{seed}:{name}")]
    trials = df.sparkSession.createDataFrame(
        [(m, i, ",".join(f"{x}={v:.6g}" for x, v in sorted(p.items())), s, e) for m, i, p, s, e in rows],
        "model string, trial int, params string, score double, error string")
    scored = [r for r in rows if r[3] is not None]
    if not scored:
        t = train_simple(df, target, features, task, models)
        best = t.leaderboard.orderBy(F.desc("score"), "model").first()
        return Searched(trials, t.best_name, {}, best["score"], t.model, "defaults", t.assembler)
    m, _, p, s, _ = max(scored, key=lambda r: r[3])
    return Searched(trials, m, p, s, fitted(m, p, data), "search", pm)


def search_preprocess_model(df: DataFrame, target: str, num_cols: list[str], cat_cols: list[str], task: str,
                            folds: int = 5, seed: int = 42, trees: int = 300) -> DataFrame:
    """M-3 / K-10: imputer × scaler combos × 2 models, k-fold mean score with the
    hash-based ``_fold`` column (``CrossValidator(foldCol=...)``)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import Imputer, MinMaxScaler, StandardScaler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    from .encode import ml_onehot_stages
    from .sample import kfold_assign
    data = kfold_assign(df, folds, target if task == "classification" else None, seed)
    if task == "classification":
        data = StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc").fit(data).transform(data)
        ev = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")
        models = [("LogisticRegression", LogisticRegression(featuresCol=FEATURES, labelCol=LABEL)),
                  ("RandomForest", RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, seed=seed))]
    else:
        data = data.withColumn(LABEL, c(target).cast("double"))
        ev = RegressionEvaluator(labelCol=LABEL, metricName="r2")
        models = [("Ridge", LinearRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=1.0)),
                  ("RandomForest", RandomForestRegressor(featuresCol=FEATURES, labelCol=LABEL, numTrees=trees, seed=seed))]
    # every fold of every grid cell reads this table: write it once instead of
    # recomputing the fold ranking for each of the many small fit jobs
    from ..session import checkpoint
    data = checkpoint(data)
    combos = [("mean", "standard"), ("median", "standard"), ("mean", "minmax"), ("median", "minmax"), ("mode", "standard")]
    tried = []
    for imp, sc in combos:
        imp_cols = [f"{x}__imp" for x in num_cols]
        stages = [Imputer(inputCols=num_cols, outputCols=imp_cols, strategy=imp),
                  VectorAssembler(inputCols=imp_cols, outputCol="__num", handleInvalid="keep"),
                  (StandardScaler(inputCol="__num", outputCol="__nums", withMean=True) if sc == "standard"
                   else MinMaxScaler(inputCol="__num", outputCol="__nums"))]
        if cat_cols:
            stages += ml_onehot_stages(cat_cols)
        stages.append(VectorAssembler(inputCols=["__nums"] + [f"{x}__ohe" for x in cat_cols], outputCol=FEATURES))
        tried += [(imp, sc, mname, stages + [est]) for mname, est in models]
    # one validator tries all pipelines: a fold is cached once for them, they are fitted side by side, and only
    # the best is fitted on all rows
    pipe = Pipeline(stages=[])
    grid = ParamGridBuilder().addGrid(pipe.stages, [t[3] for t in tried]).build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, foldCol="_fold", numFolds=folds,
                        parallelism=len(grid), seed=seed)
    rows = [(imp, sc, mname, float(score)) for (imp, sc, mname, _), score in zip(tried, cv.fit(data).avgMetrics, strict=True)]
    return df.sparkSession.createDataFrame(rows, "imputer string, scaler string, model string, cv_score double")


FAMILIES = {"classification": ("RandomForest", "GradientBoosting", "LogisticRegression"),
            "regression": ("RandomForest", "GradientBoosting", "LinearRegression")}


def outputs(pred: DataFrame, task: str, name: str) -> DataFrame:
    """The model's output as array<double> ``name``: class probabilities, or the number alone.  One-against-rest
    models give a margin for each class, which the logistic function and a division turn into shares."""
    if task == "regression":
        return pred.withColumn(name, F.array("prediction"))
    if "probability" in pred.columns:
        return pred.withColumn(name, vector_to_array("probability"))
    odds = F.transform(vector_to_array("rawPrediction"), lambda v: 1.0 / (1.0 + F.exp(-2.0 * v)))
    return pred.withColumn("_odds", odds).withColumn(
        name, F.transform("_odds", lambda v: v / F.aggregate("_odds", F.lit(0.0), lambda a, b: a + b))).drop("_odds")


def out_of_fold(data: DataFrame, families, task: str, k: int, seed: int = 42, at_once: int = 4):
    """(out of fold, bagged) for ``data`` (_rid, label, features, _split, _fold): tables (_rid, _fold, label, seen,
    family, out).  A train row is scored by the one model that did not see its fold, named by ``seen``; a test row
    by all of a family's models, whose mean output is the bagged member's."""
    from multiprocessing.pool import ThreadPool

    folds = sorted(r[0] for r in data.where("_split = 'train'").select("_fold").distinct().collect())
    tr, te = data.where("_split = 'train'"), data.where("_split = 'test'")

    def run(job):
        m, f = job
        fit = model_factory(m, task, n_classes=k, seed=seed).fit(tr.where(F.col("_fold") != f))
        keep = ["_rid", "_fold", LABEL, F.lit(f).alias("seen"), F.lit(m).alias("family"), "out"]
        return [outputs(fit.transform(x), task, "out").select(*keep) for x in (tr.where(F.col("_fold") == f), te)]

    with ThreadPool(at_once) as pool:
        made = pool.map(run, [(m, f) for m in families for f in folds])
    return tuple(reduce(DataFrame.unionByName, [x[i] for x in made]) for i in (0, 1))


def mean_outputs(table: DataFrame) -> DataFrame:
    """(_rid, label, family, out): the mean output of a family's models for each row."""
    parts = table.select("_rid", LABEL, "family", F.posexplode("out").alias("i", "v")) \
        .groupBy("_rid", LABEL, "family", "i").agg(F.avg("v").alias("v"))
    return parts.groupBy("_rid", LABEL, "family").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("out"))


def side_by_side(table: DataFrame, families) -> DataFrame:
    """(_rid, label, one array column a family)."""
    return table.groupBy("_rid", LABEL).pivot("family", list(families)).agg(F.first("out"))


def _blend(names: list[str]) -> Column:
    total = F.col(names[0])
    for n in names[1:]:
        total = F.zip_with(total, F.col(n), lambda a, b: a + b)
    return F.transform(total, lambda v: v / len(names))


def _as_prediction(out: Column, task: str) -> Column:
    return out[0] if task == "regression" else (F.array_position(out, F.array_max(out)) - 1).cast("double")


def greedy_weights(wide: DataFrame, families, task: str, rounds: int = 10) -> list[str]:
    """Families picked one after the other, again if it helps, whose mean output scores best on ``wide``."""
    chosen, best = [], None
    for _ in range(rounds):
        tried = {}
        preds = {m: _as_prediction(_blend([*chosen, m]), task) for m in families}
        good = {m: (-F.avg((p - F.col(LABEL)) ** 2) if task == "regression" else F.avg((p == F.col(LABEL)).cast("double")))
                for m, p in preds.items()}
        tried = wide.agg(*[e.alias(m) for m, e in good.items()]).first().asDict()
        m = max(families, key=lambda x: tried[x])
        if best is not None and tried[m] <= best + 1e-12:
            break
        best, chosen = tried[m], [*chosen, m]
    return chosen


def train_portfolio(df: DataFrame, target: str, features: list[str], task: str = "classification",
                    families: tuple | None = None, folds: int = 5, rounds: int = 10, seed: int = 42) -> DataFrame:
    """M-4: model families bagged over folds, a greedy weighted mean of them and a stack whose second layer learns
    from out-of-fold outputs, for any number of classes or a number.  (model, kind, weights, oof_score, score): the
    train rows' out-of-fold score and the hold-out's, best hold-out first."""
    from ..session import checkpoint
    from .sample import kfold_assign

    families = families or FAMILIES[task]
    data, _ = prepare(df, target, features, task)
    data = data.select("_rid", LABEL, FEATURES, "_split")
    train = kfold_assign(data.where("_split = 'train'"), folds, LABEL if task == "classification" else None, seed)
    data = checkpoint(train.unionByName(data.where("_split = 'test'").withColumn("_fold", F.lit(-1)), allowMissingColumns=True))
    k = data.where("_split = 'train'").select(F.count_distinct(LABEL)).first()[0] if task == "classification" else 0
    oof, bagged = out_of_fold(data, families, task, k, seed)
    inside = checkpoint(side_by_side(oof, families))
    outside = checkpoint(side_by_side(mean_outputs(bagged), families))

    def scored(table, out):
        return float(score_predictions(table.select(LABEL, _as_prediction(out, task).alias("prediction")), task))

    rows = [(m, "bagged", None, scored(inside, F.col(m)), scored(outside, F.col(m))) for m in families]
    chosen = greedy_weights(inside, families, task, rounds)
    weights = ",".join(f"{m}:{chosen.count(m) / len(chosen):.2f}" for m in families if m in chosen)
    rows.append(("WeightedEnsemble", "blend", weights, scored(inside, _blend(chosen)), scored(outside, _blend(chosen))))
    second = model_factory("Logistic" if task == "classification" else "Ridge", task, {"regParam": 0.01}, n_classes=k, seed=seed)
    layer = {n: t.select(LABEL, array_to_vector(F.concat(*[F.col(m) for m in families])).alias(FEATURES))
             for n, t in (("in", inside), ("out", outside))}
    stack = second.fit(layer["in"])
    rows.append(("Stack", "stack", None, *(float(score_predictions(stack.transform(layer[x]), task)) for x in ("in", "out"))))
    lb = df.sparkSession.createDataFrame(rows, "model string, kind string, weights string, oof_score double, score double")
    return lb.orderBy(F.desc("score"), "model")


def train_gbt_large(df: DataFrame, target: str, features: list[str], task: str, rounds: int = 100, depth: int = 6,
                    rate: float = 0.3, bins: int = 64) -> Trained:
    """M-5: boosted trees for the large path, for numbers and any number of classes (softmax), see ``boost``.  The
    leaderboard has the hold-out's weighted F1 or R²."""
    from . import boost

    if task == "classification":
        index = StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc", handleInvalid="skip")
        pm = Pipeline(stages=[index]).fit(df.where(F.col("_split") == "train"))
        data, k = pm.transform(df), len(pm.stages[0].labels)
    else:
        data, k, pm = df.withColumn(LABEL, c(target).cast("double")), 0, None
    model = boost.fit_boosted(data.where(F.col("_split") == "train"), LABEL, features, task, k, rounds, depth, rate, bins=bins)
    pred = boost.predict(data.where(F.col("_split") == "test"), model).select(LABEL, "prediction")
    score = X.regression_metrics(pred, LABEL, "prediction").first()["r2"] if task == "regression" \
        else X.classification_metrics(pred, LABEL, "prediction").first()["f1_weighted"]
    lb = df.sparkSession.createDataFrame([("GradientBoosting", float(score))], "model string, score double")
    return Trained(lb, "GradientBoosting", model, pm, features)


def training_plan(profile: DataFrame, preference: str = "balanced", preferred: list[str] | None = None) -> DataFrame:
    """M-6 over the compact profile (n_rows, n_columns): > 700,000 rows → large path;
    > 10,000 rows or > 20 features → portfolio; else simple.  Budget from the preset."""
    budget = {"fast": 90, "balanced": 180, "best": 600}.get(preference, 180)
    approach = (F.when(F.col("n_rows") > 700000, "large").when((F.col("n_rows") > 10000) | (F.col("n_columns") > 20),
                                                              "portfolio").otherwise("simple"))
    models = ",".join(preferred) if preferred else "RandomForest,GradientBoosting,LogisticRegression"
    return profile.select(approach.alias("approach"), F.lit(models).alias("models"),
                          F.lit(budget).cast("int").alias("budget"), F.lit(preference).alias("preset"))


def feature_importance(model, features: list[str], top: int = 20) -> list[tuple[str, float]]:
    """M-7: tree importances or |coefficients| (first row for multinomial), sorted, top 20."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficients"):
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    elif hasattr(model, "coefficientMatrix"):
        vals = [abs(v) for v in model.coefficientMatrix.toArray()[0].tolist()]
    else:
        vals = [0.0] * len(features)
    pairs = sorted(zip(features, vals), key=lambda t: (-t[1], t[0]))
    return pairs[:top]
