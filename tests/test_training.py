"""Training: boosted trees against a plain fit, the search, the portfolio's out-of-fold tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.operators import boost
from tablesmith.operators import train as M


def made(n=500, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.3).astype(int) + (x[:, 2] > 0.8)
    return x, y


def plain_fit(x, edges, y, task, classes, rounds, depth, rate=0.3, l2=1.0):
    """The textbook algorithm, node by node over lists of rows."""
    bins = np.stack([np.searchsorted(e, x[:, k], "left") + 1 for k, e in enumerate(edges)], axis=1)
    bins[np.isnan(x)] = 0
    n_trees = classes if task == "classification" and classes > 2 else 1
    base = y.mean() if task == "regression" else 0.0
    scores = np.full((len(x), n_trees), float(base))
    for _ in range(rounds):
        if task == "regression":
            g, h = scores - y[:, None], np.ones_like(scores)
        elif classes == 2:
            p = 1 / (1 + np.exp(-scores))
            g, h = p - y[:, None], p * (1 - p)
        else:
            e = np.exp(scores)
            p = e / e.sum(axis=1, keepdims=True)
            g, h = p - np.eye(classes)[y], p * (1 - p)
        new = scores.copy()
        for k in range(n_trees):
            def grow(rows, level):
                tg, th = g[rows, k].sum(), h[rows, k].sum()
                best = (1e-9, None)
                if level < depth:
                    for f in range(x.shape[1]):
                        for at in range(len(edges[f]) + 1):
                            left = rows[bins[rows, f] <= at]
                            right = rows[bins[rows, f] > at]
                            lh, rh = h[left, k].sum(), h[right, k].sum()
                            if lh < 1 or rh < 1:
                                continue
                            gain = round(g[left, k].sum() ** 2 / (lh + l2) + g[right, k].sum() ** 2 / (rh + l2) - tg ** 2 / (th + l2), 9)
                            if gain > best[0]:
                                best = (gain, (left, right))
                if best[1] is None:
                    new[rows, k] += -rate * tg / (th + l2)
                else:
                    for part in best[1]:
                        grow(part, level + 1)
            grow(np.arange(len(x)), 0)
        scores = new
    return scores


@pytest.mark.parametrize("task,classes", [("classification", 3), ("classification", 2), ("regression", 0)])
def test_boosted_trees_match_a_plain_fit(spark, monkeypatch, task, classes):
    x, y = made()
    x[::17, 1] = np.nan
    label = x[:, 0] * 2 + (x[:, 2] > 0) if task == "regression" else np.minimum(y, classes - 1)
    df = spark.createDataFrame([(k, float(t), *[None if np.isnan(v) else float(v) for v in r]) for k, (t, r) in enumerate(zip(label, x, strict=True))],
                               "_rid long, y double, a double, b double, c double")
    monkeypatch.setattr(boost, "CUT", 2)                # scores are renewed in between
    monkeypatch.setattr(boost, "ROWS_A_TASK", 150)      # sums come from several tasks
    model = boost.fit_boosted(df, "y", ["a", "b", "c"], task, classes, rounds=5, depth=3, bins=16)
    got = {r["_rid"]: r["probability"] for r in boost.predict(df, model).select("_rid", "probability").collect()}
    want = plain_fit(x, model.edges, label if task == "regression" else label.astype(int), task, classes, 5, 3)
    want = boost.probabilities(want, task, classes)
    assert np.allclose(np.array([got[k] for k in range(len(x))]), want, atol=1e-6)


def test_gbt_large_learns_three_classes(spark):
    x, y = made(600, 5)
    names = np.array(["low", "mid", "top"])
    df = spark.createDataFrame([(k, str(names[t]), *map(float, r), "test" if k % 5 == 0 else "train")
                                for k, (t, r) in enumerate(zip(y, x, strict=True))],
                               "_rid long, y string, a double, b double, c double, _split string")
    t = M.train_gbt_large(df, "y", ["a", "b", "c"], "classification", rounds=8, depth=3)
    assert t.leaderboard.first()["score"] > 0.9
    assert len(t.model.rounds) == 8 and all(len(r) == 3 for r in t.model.rounds)


def test_forest_on_histograms_grows_the_tree_of_a_plain_fit(spark, monkeypatch):
    """one tree without bags is the regression tree over the same values."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    from tablesmith.operators import forest as R
    from tablesmith.session import checkpoint
    rng = np.random.default_rng(6)
    x = np.stack([rng.integers(0, n, 3000) for n in (20, 7, 11, 2, 2, 2, 2, 3)], axis=1)
    y = 50 + x[:, 0] * 3.0 + (x[:, 1] - 3) ** 2 * (x[:, 3] + 1) + rng.normal(size=3000)
    names = [f"x{k}" for k in range(8)]
    df = spark.createDataFrame([(float(t), *map(float, r)) for t, r in zip(y, x, strict=True)], ["y", *names]).repartition(3)
    monkeypatch.setattr(R, "BLOCK_ROWS", 400)
    monkeypatch.setattr(R, "poisson_weights", lambda: np.ones(R.DRAWN))
    for some in (names[:4], names):
        d = checkpoint(VectorAssembler(inputCols=some, outputCol="v").transform(df))
        model = R.fit_forest(d, "y", "v", trees=1, depth=4)
        want = DecisionTreeRegressor(featuresCol="v", labelCol="y", maxDepth=4, predictionCol="want").fit(d)
        got = want.transform(model.transform(d)).select("prediction", "want").collect()
        assert np.allclose([r[0] for r in got], [r[1] for r in got], rtol=1e-9)
        assert np.allclose(model.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-6)


def test_large_forests_of_numbers_are_grown_on_histograms(spark, monkeypatch):
    """MLlib's forest kept a weight for every row and tree and walked all trees for every row and level."""
    from tablesmith.operators import forest as R
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 3)).round(1)
    y = 3 * x[:, 0] + np.abs(x[:, 1]) + rng.normal(size=4000) * 0.5
    df = spark.createDataFrame([(float(t), *map(float, r), "test" if k % 5 == 0 else "train") for k, (t, r) in enumerate(zip(y, x, strict=True))],
                               "y double, a double, b double, c double, _split string").repartition(4)
    small = M.train_simple(df, "y", ["a", "b", "c"], "regression", models=("RandomForest",))
    monkeypatch.setattr(M, "LARGE", 1000)
    monkeypatch.setattr(R, "BLOCK_ROWS", 700)
    monkeypatch.setattr(M.RandomForestRegressor, "fit", None)
    large = M.train_simple(df, "y", ["a", "b", "c"], "regression", models=("RandomForest", "LinearRegression"))
    scores = {r["model"]: r["score"] for r in large.leaderboard.collect()}
    assert abs(scores["RandomForest"] - small.leaderboard.first()["score"]) < 0.08       # seeds differ by 0.06
    one, two = (dict(M.feature_importance(t.model, ["a", "b", "c"])) for t in (small, M.train_simple(df, "y", ["a", "b", "c"], "regression", models=("RandomForest",))))
    assert max(abs(one[k] - two[k]) for k in "abc") < 0.05 and abs(sum(two.values()) - 1) < 1e-9
    with pytest.raises(ValueError, match="1 labels"):       # as MLlib's
        R.fit_forest(M.prepare(df.limit(9).unionByName(df.limit(1).withColumn("y", F.lit(None))), "y", ["a"], "regression")[0], M.LABEL, M.FEATURES)
    w = np.bincount(R.poisson_weights().astype(int)) / R.DRAWN
    assert all(abs(w[k] - np.exp(-1) / math.factorial(k)) < 2 / R.DRAWN for k in range(8))


def test_search_is_seeded_and_not_below_random_draws():
    space = {"x": ("float", 0.0, 1.0), "n": ("int", 1, 50), "r": ("logfloat", 1e-3, 10.0), "c": ("choice", ["a", "b", "d"])}

    def score(p):
        return -(p["x"] - 0.3) ** 2 - ((p["n"] - 40) / 50) ** 2 - (0.2 if p["c"] != "b" else 0.0)

    def best(rows):
        return max(s for _, _, s, _ in rows)

    a, b = M.search(space, score, 30, "7"), M.search(space, score, 30, "7")
    assert a == b and [r[0] for r in a] == list(range(30))
    assert all(0 <= p["x"] <= 1 and 1 <= p["n"] <= 50 and 1e-3 <= p["r"] <= 10 for _, p, _, _ in a)
    sampled, drawn = [], []
    for seed in range(60):
        sampled.append(best(M.search(space, score, 30, f"s{seed}")))
        rng = random.Random(f"r{seed}")
        drawn.append(max(score({k: M._from_unit(s, rng.random()) for k, s in space.items()}) for _ in range(30)))
    assert np.mean(sampled) > np.mean(drawn)
    failed = M.search({"x": ("float", 0.0, 1.0)}, lambda p: 1 / 0 if p["x"] < 0 else int("no"), 5)
    assert all(s is None and "invalid literal" in e for _, _, s, e in failed)


def test_units_of_parameters():
    for spec, values in ((("int", 3, 20), [3, 11, 20]), (("float", -1.0, 4.0), [-1.0, 0.5, 3.9]),
                         (("logfloat", 1e-3, 0.3), [1e-3, 0.02, 0.29]), (("choice", ["a", "b"]), ["a", "b"])):
        for v in values:
            back = M._from_unit(spec, M._to_unit(spec, v))
            assert back == v or abs(back - v) < 1e-9


@pytest.fixture(scope="module")
def three(spark):
    x, y = made(240, 9)
    return spark.createDataFrame([(k, "uvw"[t], *map(float, r), "test" if k % 4 == 0 else "train")
                                  for k, (t, r) in enumerate(zip(y, x, strict=True))],
                                 "_rid long, y string, a double, b double, c double, _split string")


def test_train_search_falls_back_to_defaults(spark, three):
    bad = {"LogisticRegression": {"regParam": ("float", -2.0, -1.0)}}       # refused by the estimator
    got = M.train_search(three, "y", ["a", "b", "c"], "classification", ("LogisticRegression",), 5, spaces=bad)
    rows = got.trials.collect()
    assert len(rows) == 5 and all(r["score"] is None and r["error"] for r in rows)
    assert (got.method, got.best_name) == ("defaults", "LogisticRegression") and got.best_score > 0.5
    good = M.train_search(three, "y", ["a", "b", "c"], "classification", ("LogisticRegression",), 5)
    assert good.method == "search" and good.best_score == max(r["score"] for r in good.trials.collect())


def test_deep_forests_of_a_search_keep_the_nodes_of_rows_and_are_the_same(spark, three, monkeypatch):
    seen, fit = [], M.RandomForestClassifier.fit
    monkeypatch.setattr(M.RandomForestClassifier, "fit", lambda self, *a: (seen.append(
        (self.getMaxDepth(), self.getCacheNodeIds())), fit(self, *a))[1])
    space = {"RandomForest": {"numTrees": ("int", 4, 8), "maxDepth": ("choice", [4, 9])}}
    got = M.train_search(three, "y", ["a", "b", "c"], "classification", ("RandomForest",), 5, spaces=space)
    assert len(seen) == 6 and {d for d, _ in seen} == {4, 9} and all(kept == (d > M.DEEP) for d, kept in seen)
    data, _ = M.prepare(three, "y", ["a", "b", "c"], "classification")
    p = {"numTrees": 8, "maxDepth": 9}
    one, two = (wrap(M.model_factory("RandomForest", "classification", p, n_classes=3)).fit(data) for wrap in (M.kept_nodes, lambda e: e))
    assert one.toDebugString.split("\n", 1)[1] == two.toDebugString.split("\n", 1)[1] and one.totalNumNodes > 8
    assert len(got.trials.collect()) == 5


def test_portfolio_scores_no_row_by_a_model_that_saw_it(spark, three):
    from tablesmith.operators.sample import kfold_assign
    data, _ = M.prepare(three, "y", ["a", "b", "c"], "classification")
    data = data.select("_rid", M.LABEL, M.FEATURES, "_split")
    train = kfold_assign(data.where("_split = 'train'"), 3, M.LABEL)
    data = train.unionByName(data.where("_split = 'test'").withColumn("_fold", F.lit(-1)), allowMissingColumns=True)
    oof, bagged = M.out_of_fold(data, ("LogisticRegression", "GradientBoosting"), "classification", 3)
    rows = oof.collect()
    assert all(r["_fold"] == r["seen"] for r in rows)                       # the model of a fold never saw it
    assert len(rows) == 2 * 180 and len({(r["_rid"], r["family"]) for r in rows}) == len(rows)
    assert all(abs(sum(r["out"]) - 1) < 1e-9 and len(r["out"]) == 3 for r in rows)
    assert {(r["family"], r["count"]) for r in bagged.groupBy("family").count().collect()} == {
        ("LogisticRegression", 3 * 60), ("GradientBoosting", 3 * 60)}


def test_portfolio_of_three_classes_and_of_a_number(spark, three):
    lb = M.train_portfolio(three, "y", ["a", "b", "c"], "classification", ("RandomForest", "LogisticRegression"), folds=3)
    rows = {r["model"]: r for r in lb.collect()}
    assert set(rows) == {"RandomForest", "LogisticRegression", "WeightedEnsemble", "Stack"}
    assert rows["WeightedEnsemble"]["oof_score"] >= max(rows[m]["oof_score"] for m in ("RandomForest", "LogisticRegression")) - 1e-9
    num = three.withColumn("y", F.col("a") * 2 + F.col("b"))
    rows = {r["model"]: r for r in M.train_portfolio(num, "y", ["a", "b", "c"], "regression", ("RandomForest", "LinearRegression"), folds=3).collect()}
    assert rows["LinearRegression"]["score"] > 0.99 and rows["Stack"]["score"] > 0.95
