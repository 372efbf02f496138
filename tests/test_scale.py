"""Operators whose large-table path is forced on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK


@pytest.mark.parametrize("shape", ["normal", "ties", "tail"])
def test_narrowed_quantiles_and_ranks_are_exact(spark, monkeypatch, shape):
    from tablesmith.operators import quantiles as Q
    monkeypatch.setattr(Q, "RANKED", 30)
    rng = np.random.default_rng(2)
    x = {"normal": rng.normal(size=6000), "ties": rng.integers(0, 9, 6000).astype(float),
         "tail": np.exp(rng.normal(size=6000) * 4)}[shape]
    df = spark.createDataFrame([(float(v), float(-v), int(k)) for k, v in enumerate(x)], "a double, b double, k long").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.251, 0.5, 0.99, 1.0]
    got = {(r["column"], r["p"]): r["value"] for r in Q.quantile_table(df, ["a", "b"], probs, accuracy=200).collect()}
    for name, v in (("a", x), ("b", -x)):
        for p in probs:
            assert math.isclose(got[name, p], np.quantile(v, p), rel_tol=1e-12, abs_tol=1e-12)
    ordered = np.sort(x)
    for r in (0, 1, 17, 3000, 5998, 5999):
        assert Q.value_at_rank(df, "a", r, accuracy=200) == ordered[r]
    assert Q.value_at_rank(df, "k", 4321, accuracy=200) == 4321
    assert Q.value_at_rank(df, "a", 6000) is None and Q.value_at_rank(df, "a", -1) is None


def test_even_quantiles_of_several_sizes(spark):
    from tablesmith.operators.quantiles import even_quantiles
    rng = np.random.default_rng(3)
    cols = {"a": rng.normal(size=700), "b": rng.integers(0, 5, 700).astype(float), "c": np.array([4.0]), "d": np.array([1.0, 9.0])}
    lv = spark.createDataFrame([(n, float(v)) for n, x in cols.items() for v in x], "column string, value double").repartition(4)
    sizes = {"a": 100, "b": 37, "c": 2, "d": 2}
    got = {(r["column"], r["j"]): r["value"] for r in even_quantiles(lv, sizes).collect()}
    assert len(got) == sum(sizes.values())
    for n, m in sizes.items():
        for j in range(m):
            assert math.isclose(got[n, j], np.quantile(cols[n], j / (m - 1)), rel_tol=1e-12, abs_tol=1e-12)


def test_gram_of_many_columns_with_gaps(spark, monkeypatch):
    from tablesmith.operators import gram as G
    from tablesmith.operators.relate import corr_long
    monkeypatch.setattr(G, "FAN_IN", 2)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 40)) + 1e6
    x[:, 1] = x[:, 0] * -2 + rng.normal(size=300) * 0.1
    x[:, 2] = 7.0
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 3] = np.nan
    x[5:, 4] = np.nan
    names = [f"c{k}" for k in range(40)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x],
                               ", ".join(f"{n} double" for n in names)).repartition(7)
    got = {(r["a"], r["b"]): r["corr"] for r in corr_long(df, names).collect()}
    assert len(got) == 40 * 39 // 2
    for i in range(40):
        for j in range(i + 1, 40):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            want = None if len(a) < 2 or a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
            v = got[f"c{i}", f"c{j}"]
            assert (v is None) == (want is None) and (want is None or abs(v - want) < 1e-6)
    varying = corr_long(df, names, diagonal=True, varying=True)
    assert {r["a"] for r in varying.collect()} == {
        n for k, n in enumerate(names) if len(set(x[~np.isnan(x[:, k]), k])) > 1}
    assert corr_long(df.where(F.lit(False)), names).where("corr IS NOT NULL").count() == 0


def test_order_cuts_with_a_forced_narrowing(spark, monkeypatch):
    from tablesmith.operators import outliers as O
    from tablesmith.operators import quantiles as Q
    from tablesmith.operators import sample as D
    monkeypatch.setattr(Q, "RANKED", 10)
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("_rid"), (F.col("id") % 10).cast("double").alias("x")).repartition(6)
    out = D.split_ordered(df, 0.2)
    assert out.where("_split = 'test'").agg(F.min("_rid"), F.max("_rid"), F.count("*")).first() == (4000, 4999, 1000)
    assert D.split_ordered(df.limit(1), 0.9).where("_split = 'test'").count() == 1
    bounds = spark.createDataFrame([("x", 2.0, 9.0)], "column string, lower double, upper double")
    bad = sorted(r["_rid"] for r in df.where("x < 2").collect())
    kept = O.remove_outlier_rows_capped(df, bounds, 0.05)
    assert kept.count() == 4750
    assert sorted(r["_rid"] for r in kept.where("x < 2").collect()) == bad[250:]


def test_small_tables_of_few_row_groups_are_dealt_to_all_cores(spark, monkeypatch):
    from tablesmith.sources import tables
    plain = spark.read.parquet(f"{SF_CHECK}/lineitem.parquet")
    rows = sorted(map(tuple, plain.collect()))

    def dealt():
        df = tables.read_table(spark, SF_CHECK, "lineitem")
        assert sorted(map(tuple, df.collect())) == rows
        return "Repartition " in df._jdf.queryExecution().optimizedPlan().toString()

    assert not dealt()                                  # under SPREAD_FROM bytes
    monkeypatch.setattr(tables, "SPREAD_FROM", 1)
    assert dealt()
    narrow = tables.read_table(spark, SF_CHECK, "lineitem").where("l_tax > 0.02").select("l_discount")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_partkey" not in plan and "GreaterThan(l_tax" in plan
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        assert not dealt()                              # more than a split a core: read as it is
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_neighbours_of_wide_vectors_by_tiles(spark, monkeypatch):
    """Vectors without clusters, with ties, copies, groups of few rows and numbers far from zero: by brute force."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from tablesmith.operators import knn as NN
    monkeypatch.setattr(NN, "TILE_CELLS", 1 << 12)
    monkeypatch.setattr(NN, "BLOCK_BYTES", 128 * 8 * 12)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 2, size=(900, 12)).astype(float), rng.normal(size=(500, 12)), 1e7 + rng.normal(size=(200, 12)),
                        np.ones((40, 12))])
    ids = rng.permutation(len(x)) * 7
    group = np.where(np.arange(len(x)) % 300 == 0, "few", np.where(np.arange(len(x)) % 2 == 0, "a", "b"))
    rows = [(int(i), v.tolist(), str(g)) for i, v, g in zip(ids, x, group, strict=True)]
    v = spark.createDataFrame(rows, "id long, x array<double>, g string").withColumn("features", array_to_vector("x"))
    d2 = np.zeros((len(x), len(x)))
    for k in range(12):
        d2 += (x[:, None, k] - x[None, :, k]) ** 2
    d = np.sqrt(d2)
    for same in (None, "g"):
        want = {}
        for a in range(len(x)):
            may = np.flatnonzero((np.arange(len(x)) != a) & ((group == group[a]) if same else True))
            want[int(ids[a])] = [int(ids[b]) for b in may[np.lexsort((ids[may], d[a, may]))][:4]]
        got = {}
        for r in sorted(NN.knn_join(v, v, k=4, same_group=same).collect(), key=lambda r: (r["id"], r["rank"])):
            got.setdefault(r["id"], []).append(r["nb_id"])
        assert got == want


def test_knn_imputation_of_copies_takes_few_rounds(spark, monkeypatch):
    """Equal rows, more than a round's candidates, are searched once; of equal donors the smallest ids count."""
    from tablesmith.operators import knn as NN
    monkeypatch.setattr(NN, "MOST", 4)
    met, plain = [], NN.candidates
    monkeypatch.setattr(NN, "candidates", lambda *a, **k: met.append(1) or plain(*a, **k))
    rows = [(k, float(k % 3), None if k % 2 else float(k // 3 % 4), "train") for k in range(240)]
    df = spark.createDataFrame(rows, "_rid long, a double, b double, _split string")
    got = {r["_rid"]: r["b"] for r in NN.impute_knn(df, ["a", "b"], k=3).collect()}
    for k, a, b, _ in rows:
        given = sorted(j for j, x, y, _ in rows if x == a and y is not None)[:3]
        assert got[k] == (b if b is not None else sum(rows[j][2] for j in given) / 3)
    assert len(met) <= 8


def test_docs_measures_texts_before_the_join(spark):
    from tablesmith.sources.tables import view
    plan = view(spark, SF_CHECK, "docs")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("length(text")


def test_preprocessing_search_is_one_validator(spark, monkeypatch):
    from pyspark.ml import tuning
    from tablesmith.operators import train as M
    made, plain = [], tuning.CrossValidator.fit
    monkeypatch.setattr(tuning.CrossValidator, "fit", lambda cv, d: made.append(len(cv.getEstimatorParamMaps())) or plain(cv, d))
    df = spark.createDataFrame([(k, float(k % 7), "xy"[k % 2], k % 2) for k in range(80)], "_rid long, a double, b string, y int")
    got = M.search_preprocess_model(df, "y", ["a"], ["b"], "classification", folds=2, trees=2).collect()
    assert made == [10] and len({(r["imputer"], r["scaler"], r["model"]) for r in got}) == 10
    assert all(r["cv_score"] > 0.9 for r in got if r["model"] == "LogisticRegression")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_static_flow_splits_written_rows_and_skips_texts_that_are_no_dates(spark, monkeypatch):
    """the de-duplication ran again for the task, the split's counts and its cut."""
    from tablesmith.functions.types import DATE_FORMATS, parse_datetime
    from tablesmith.plans import preprocess as PP
    texts = ["2024-02-03", " 2024/02/03 ", "2024-02-03 04:05:06", "2024-02-03T04:05:06", "02/03/2024", "03-02-2024", "3 Feb 2024",
             "Feb 3, 2024", "L123", "2024", "1-2", "", None, "a-b-c", "x\ny z"]
    d = spark.createDataFrame([(x,) for x in texts], "t string")
    each = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in DATE_FORMATS])
    got = d.select(parse_datetime(F.col("t")).alias("a"), each.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.a is not None for r in got) == 8
    assert "RLIKE" in _plan(d.select(parse_datetime(F.col("t"))))
    plans, split = [], PP.D.split_stratified
    monkeypatch.setattr(PP.D, "split_stratified", lambda df, *a: plans.append(_plan(df)) or split(df, *a))
    rows = [(k, float(k % 37), "L" + str(k), "ab"[k % 2]) for k in range(400)]
    PP.preprocess_static(spark.createDataFrame(rows, "_rid long, x double, t string, y string"), "y")
    assert len(plans) == 1 and "Aggregate" not in plans[0]


def test_first_values_come_from_the_first_rows(spark):
    """all values of all columns were sorted for the first five of each."""
    from tablesmith.operators import sample as D
    from tablesmith.plans import column_plan as L
    n = 900
    rows = [(n - k, float(k), None if n - k < 600 else "s" + str(k), None) for k in range(n)]
    df = spark.createDataFrame(rows, "_rid long, x double, late string, none string").repartition(7)
    got = {r["column"]: r["sample_values"] for r in L.evidence(df, None).collect()}
    assert got["x"] == "899.0,898.0,897.0,896.0,895.0" and got["none"] == ""
    assert got["late"] == ",".join("s" + str(n - k) for k in range(600, 605))
    assert "Range" not in _plan(D.first_values(spark.range(1000).select(F.col("id").alias("_rid"), "id"), ["id"], 5))


def test_values_of_the_lowest_hashes(spark):
    """every value of every column was ranked, and hashed in each of several scans."""
    from tablesmith.functions.hashing import hash_int
    from tablesmith.operators import charts as C, normality as N, sample as D
    df = spark.range(5000).select(F.col("id").alias("_rid"), F.sqrt("id").alias("a"),
                                  F.when(F.col("id") % 40 == 0, F.col("id").cast("double")).alias("b"),
                                  F.when(F.col("id") < 3, 1.0).alias("few"), F.lit(None).cast("double").alias("none")).repartition(6)
    ranked = df.withColumn("h", hash_int("_rid", 42)).orderBy("h", "_rid").collect()
    got = C.chart_sample(df, ["a", "b", "few", "none"], 50)
    assert "Range" not in _plan(got)
    rows = got.collect()
    for x in ("a", "b", "few", "none"):
        want = [r["_rid"] for r in ranked if r[x] is not None][:50]
        assert sorted(r["_rid"] for r in rows if r["column"] == x) == sorted(want)
    same = D.low_hashes(spark.createDataFrame([(7, float(k)) for k in range(300)], "_rid long, x double"), ["x"], 10)
    assert same.count() in (0, 300) and same.count() == 300        # one id: its rows come together
    flags = {r["column"]: r["n"] for r in N.shapiro_flags(df, ["a", "b", "few"], sample=200).collect()}
    assert flags == {"a": 200, "b": 125, "few": 3}


def test_grouped_quantiles_leave_the_values_where_they_are(spark):
    """F16: the values of a group were shuffled to the task of its brackets and of its fences."""
    from tablesmith.operators.charts import chart_box
    from tablesmith.operators.quantiles import quantiles_of_long
    lv = spark.range(600).select((F.col("id") % 3).cast("string").alias("column"), F.sqrt("id").alias("value"))
    assert "strategy=broadcast" in _plan(quantiles_of_long(lv, [0.25, 0.5, 0.75], few_keys=False))
    df = lv.withColumnRenamed("column", "g")
    got = {r["group"]: r for r in chart_box(df, "value", "g").collect()}
    for g in range(3):
        v = np.sqrt(np.arange(g, 600, 3))
        q = np.quantile(v, [0.25, 0.5, 0.75])
        assert np.allclose([got[str(g)][x] for x in ("q1", "median", "q3")], q)
        assert math.isclose(got[str(g)]["whisker_high"], v[v <= q[2] + 1.5 * (q[2] - q[0])].max())


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_duplicate_rows_by_hash(spark, monkeypatch, most):
    """every row was shuffled whole to be counted, and ids were aggregated by sorting."""
    from tablesmith.operators import profile as P
    from tablesmith.operators.sample import dedupe_exact
    monkeypatch.setattr(P, "MAX_BROADCAST_BYTES", most)
    nan, zero = float("nan"), 0.0
    rows = [(1, 1.0, "a"), (2, 1.0, "a"), (3, None, "a"), (None, None, "a"), (5, 1.0, None), (6, nan, "b"), (7, nan, "b"),
            (8, zero, "c"), (9, -zero, "c"), (10, 2.0, "d"), (11, 1.0, "a")]
    df = spark.createDataFrame(rows, "_rid long, x double, s string")
    got = P.duplicate_rows(df).first()
    assert (got["duplicate_rows"], got["n_rows"], got["duplicate_ratio"]) == (5, 11, 0.4545)
    if most:
        assert "xxhash64" in _plan(P.duplicate_rows(df))
    kept = dedupe_exact(df, ["x", "s"])
    assert sorted((r["_rid"] for r in kept.collect()), key=lambda v: v or 0) == [None, 1, 5, 6, 8, 10]
    assert "struct" not in _plan(kept)
    empty = P.duplicate_rows(df.where("_rid < 0")).first()
    assert (empty["duplicate_rows"], empty["n_rows"], empty["duplicate_ratio"]) == (0, 0, 0.0)


def test_report_profiles_a_table_once(spark, monkeypatch):
    """the warnings profiled all columns a second time."""
    from tablesmith.operators import ready as V
    calls = []
    for name in ("low_variance", "numeric_profile", "missing_profile"):
        real = getattr(V.P, name)
        monkeypatch.setattr(V.P, name, lambda *a, _n=name, _f=real, **k: calls.append(_n) or _f(*a, **k))
    df = spark.range(300).select((F.col("id") % 7).cast("double").alias("x"), F.lit("a").alias("s"), (F.col("id") % 2).alias("y"))
    rows = V.report(df, "y").collect()
    assert sorted(calls) == ["low_variance", "missing_profile", "numeric_profile"]
    want = {tuple(r) for r in V.quality_warnings(df, "y").select("column", "type").collect()}
    assert want and {(r["column"], r["metric"]) for r in rows if r["section"] == "warnings"} == want


def test_power_moments_in_arrow_batches(spark):
    """eighteen powers and variances of every value in each of seven rounds were row-by-row expressions."""
    from tablesmith.operators import scale as K
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=500) * 3, np.exp(rng.normal(size=500)), [0.0, -0.0]])
    df = spark.createDataFrame([(float(v), None if k % 5 else float(-v)) for k, v in enumerate(x)], "a double, b double").repartition(5)
    grid = [-3.0, -0.75, 0.0, 1.0, 2.0, 3.0]
    got = {(r["column"], r["i"]): r for r in K.power_moments(df, {"a": grid, "b": grid}).collect()}
    want = df.agg(*[F.var_pop(K.yeo_johnson(F.col(n), v)).alias(f"{n}{i}") for n in "ab" for i, v in enumerate(grid)],
                  *[F.sum(F.signum(n) * F.log1p(F.abs(F.col(n)))).alias(f"s{n}") for n in "ab"]).first()
    for n in "ab":
        for i in range(len(grid)):
            assert math.isclose(got[n, i]["v"], want[f"{n}{i}"], rel_tol=1e-9)
            assert math.isclose(got[n, i]["s"], want[f"s{n}"], rel_tol=1e-9)
            assert got[n, i]["n"] == (len(x) if n == "a" else math.ceil(len(x) / 5))
    none = df.withColumn("a", F.lit(None).cast("double"))
    assert K.fit_power(none, ["a", "b"], rounds=2).count() in (1, 2)


def test_prepared_and_recipe_rows_are_written_once(spark):
    """each of a dozen scans dealt the rows anew and hashed their ids."""
    from tablesmith.catalog import features_q, plan_q
    assert "md5" not in _plan(plan_q.prep_source(spark, "/root/testdata/sf0.001"))
    assert "md5" not in _plan(features_q.recipe_supplement(spark, "/root/testdata/sf0.001"))
