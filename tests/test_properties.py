"""Property checks for rows-only operators and hand-made edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "_split" in df.columns


def test_split_independent_of_partitioning(spark):
    from tablesmith.operators import sample as D
    from tablesmith.sources.tables import view
    d = view(spark, SF_CHECK, "li").select("_rid", "l_returnflag")
    a = D.split_stratified(d.repartition(1), "l_returnflag").where("_split = 'test'").select("_rid")
    b = D.split_stratified(d.repartition(17), "l_returnflag").where("_split = 'test'").select("_rid")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fit_uses_train_only(spark):
    from tablesmith.operators import impute as N
    df = spark.createDataFrame([(1, 1.0, "train"), (2, None, "train"), (3, 3.0, "train"), (4, 100.0, "test"),
                                (5, None, "test")], "_rid long, x double, _split string")
    out = N.apply_impute(df, N.fit_impute(df, {"x": "median"}))
    assert {r["_rid"]: r["x"] for r in out.collect()}[5] == 2.0


def test_edge_tables(spark):
    from tablesmith.operators import profile as P
    empty = spark.createDataFrame([], "a double, b string")
    assert P.missing_profile(empty).count() == 2
    const = spark.createDataFrame([(1.0, None), (1.0, None), (float("nan"), None)], "a double, b string")
    lv = {r["column"]: r for r in P.low_variance(const).collect()}
    assert lv["a"]["is_constant"] and lv["b"]["unique_count"] == 0
    miss = {r["column"]: r["missing_count"] for r in P.missing_profile(const).collect()}
    assert miss == {"a": 1, "b": 3}


def test_odd_column_names(spark):
    from tablesmith.operators import profile as P, scale as K
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 5.0)], "`a.b` double, `c d` double, `e-f` double")
    prof = P.numeric_profile(df)
    assert {r["column"] for r in prof.collect()} == {"a.b", "c d", "e-f"}
    out = K.apply_scaler(df, K.fit_scaler(df, ["a.b", "c d", "e-f"]))
    assert out.columns == ["a.b", "c d", "e-f"]


def test_unseen_category(spark):
    from tablesmith.operators import encode as E
    df = spark.createDataFrame([(1, "x", "train"), (2, "y", "train"), (3, "z", "test"), (4, None, "test")],
                               "_rid long, c string, _split string")
    oh = E.apply_onehot(df, E.fit_onehot(df, ["c"])).orderBy("_rid").collect()
    assert (oh[2]["c__x"], oh[2]["c__y"]) == (0, 0)
    lab = E.apply_label(df, E.fit_label(df, ["c"])).orderBy("_rid").collect()
    assert [r["c"] for r in lab] == [0, 1, -1, -1]


def test_exact_quantiles_agree(spark):
    from tablesmith.operators.quantiles import quantile_table
    from tablesmith.sources.tables import view
    d = view(spark, SF_SMALL, "li")
    cols = ["l_quantity", "l_extendedprice"]
    a = {(r["column"], r["p"]): r["value"] for r in quantile_table(d, cols, [0.1, 0.5, 0.9], "exact").collect()}
    b = {(r["column"], r["p"]): r["value"] for r in quantile_table(d, cols, [0.1, 0.5, 0.9], "distributed").collect()}
    for k in a:
        assert math.isclose(a[k], b[k], rel_tol=1e-12, abs_tol=1e-9)


def test_oversample_balances(spark):
    from tablesmith.operators import balance as B
    from tablesmith.sources.tables import view
    d = view(spark, SF_CHECK, "docs").where(F.col("quality").isNotNull()).select("_rid", "quality")
    counts = {r["quality"]: r["count"] for r in B.oversample(d, "quality").groupBy("quality").count().collect()}
    assert len(set(counts.values())) == 1


def test_knn_is_complete_and_forms_few_pairs(spark):
    """Every row has its k nearest, ties by id: in dense clusters, among copies of one vector and far outside."""
    import numpy as np
    from pyspark.sql import functions as F
    from tablesmith.operators import knn as NN
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(size=8) * 6 + rng.normal(size=(20, 8)) for _ in range(30)]
                         + [rng.normal(size=(40, 8)) * 1e-3, np.ones((60, 8)), rng.normal(size=(5, 8)) * 500])
    ids = rng.permutation(len(pts)) * 3
    rows = [(int(i), p.tolist(), "ab"[k % 2]) for k, (i, p) in enumerate(zip(ids, pts, strict=True))]
    rows += [(10_001, [float("nan")] * 8, "a"), (10_003, [1.0] * 8, None)]
    df = spark.createDataFrame(rows, "id long, emb array<double>, g string")
    v = NN.to_vectors(df, array_col="emb")
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))

    def brute(k, group):
        out = set()
        for a in range(len(pts)):
            others = [b for b in range(len(pts)) if b != a and (not group or a % 2 == b % 2)]
            out |= {(int(ids[a]), int(ids[b])) for b in sorted(others, key=lambda b: (round(d[a, b], 9), ids[b]))[:k]}
        return out

    got = NN.knn_join(v.where("id < 10000"), v.where("id < 10000"), k=3).collect()
    assert {(r["id"], r["nb_id"]) for r in got} == brute(3, False) and len(got) == 3 * len(pts)
    got = NN.knn_join(v, v, k=4, same_group="g").collect()
    assert {(r["id"], r["nb_id"]) for r in got} == brute(4, True)
    few = v.where("id in (0, 3, 6)")
    assert NN.knn_join(few, few, k=5).count() == 6            # min(k, rows - 1) each
    assert NN.knn_join(few, few.limit(0), k=5).count() == 0
    some = df.where("id < 10000").select(F.col("id").alias("pid"), F.lit("").alias("g"), F.col("emb").alias("x"))
    some = some.withColumn("y", NN.project(F.col("x"), NN.axes_of(some, "x", "pid")))
    base = some.withColumnRenamed("pid", "bid")
    r = NN.first_radius(some, base, 4, len(pts), 3, ["g", "c0", "c1", "c2"], (-1, 0, 1))
    assert NN.candidates(some, base, r, 3).count() < 0.1 * len(pts) ** 2


def test_knn_imputation_by_brute_force(spark):
    """Nan-Euclidean donors, also where donors lack coordinates, rows lack all others, or a column has no donor."""
    import numpy as np
    from tablesmith.operators import knn as NN
    rng = np.random.default_rng(4)
    m = np.round(rng.normal(size=(60, 3)) * [1, 10, 100], 3)
    m[5:25, 0] = m[20:40, 1] = np.nan       # rows without either, and donors that lack a coordinate
    m[0] = np.nan
    split = ["test" if k % 5 == 0 else "train" for k in range(len(m))]
    rows = [(k, *[None if np.isnan(v) else float(v) for v in r], None, s) for k, (r, s) in enumerate(zip(m, split, strict=True))]
    df = spark.createDataFrame(rows, "_rid long, a double, b double, c double, e double, _split string")
    got = {r["_rid"]: r for r in NN.impute_knn(df, list("abce"), k=3).collect()}
    full = np.column_stack([m, np.full(len(m), np.nan)])
    for k in range(len(m)):
        for i, name in enumerate("abce"):
            if not np.isnan(full[k, i]):
                assert got[k][name] == full[k, i]
                continue
            near = []
            for j in range(len(m)):
                both = ~np.isnan(full[k]) & ~np.isnan(full[j])
                if split[j] == "train" and not np.isnan(full[j, i]) and both.any():
                    near.append((np.sqrt(4 / both.sum() * ((full[k] - full[j])[both] ** 2).sum()), j))
            col = [full[j, i] for j in range(len(m)) if split[j] == "train" and not np.isnan(full[j, i])]
            want = np.mean([full[j, i] for _, j in sorted(near)[:3]]) if near else np.mean(col) if col else None
            assert got[k][name] is None if want is None else math.isclose(got[k][name], want, rel_tol=1e-9)


def test_shapiro_on_normal_and_skewed(spark):
    import numpy as np
    from tablesmith.operators.normality import shapiro_w
    rng = np.random.default_rng(0)
    # under normality p is ~uniform: about 5 % of samples fall below 0.05
    ps = [shapiro_w(rng.normal(size=300))[1] for _ in range(40)]
    assert sum(p < 0.05 for p in ps) <= 8 and 0.3 < float(np.mean(ps)) < 0.7
    assert all(shapiro_w(rng.exponential(size=300))[1] < 1e-6 for _ in range(5))


def test_fingerprint_order_free(spark):
    from tablesmith.sources import store as H
    from tablesmith.sources.tables import view
    d = view(spark, SF_SMALL, "orders")
    a = H.fingerprint(d).first()["fingerprint"]
    b = H.fingerprint(d.repartition(5).orderBy(F.rand(1))).first()["fingerprint"]
    assert a == b


def test_stream_scoring(spark):
    from tablesmith.streaming.score_stream import score_stream_once
    out = score_stream_once(spark, SF_SMALL)
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()


def test_clip_keeps_missing_values(spark):
    from tablesmith.operators.outliers import apply_clip
    d = spark.createDataFrame([(1, None), (2, -5.0), (3, 2.0), (4, 99.0)], "id int, x double")
    p = spark.createDataFrame([("x", 0.0, 10.0)], "column string, lower double, upper double")
    assert [r.x for r in apply_clip(d, p).orderBy("id").collect()] == [None, 0.0, 2.0, 10.0]


def test_onehot_never_cuts_categories(spark):
    from tablesmith.operators.encode import fit_onehot
    d = spark.range(3000).selectExpr("concat('v', id) AS x")
    with pytest.raises(ValueError, match="more than 1000 categories"):
        fit_onehot(d, ["x"])
    assert fit_onehot(d, ["x"], max_categories=3000).count() == 3000


def test_topk_skips_rejected_candidates(spark):
    from tablesmith.operators.features import select_topk
    st = spark.createDataFrame([("a", 0.9, False), ("b", -0.8, True), ("c", 0.1, True), ("d", 0.05, True)],
                               "name string, corr double, keep boolean")
    got = {r.name: (r.rank, r.selected) for r in select_topk(st, 2).collect()}
    assert got == {"a": (None, False), "b": (1, True), "c": (2, True), "d": (3, False)}


def test_guard_ignores_rows_without_class(spark):
    from tablesmith.operators.balance import undersample_guarded
    rows = [(i, "a" if i < 50 else "b" if i < 80 else None) for i in range(480)]
    d = spark.createDataFrame(rows, "_rid long, k string")
    assert undersample_guarded(d, "k").count() == 60


def test_fingerprint_sum_has_no_overflow(spark):
    from tablesmith.sources.store import fingerprint_parts
    from pyspark.sql import functions as F
    d = spark.range(1).select(F.lit("x").alias("a"))
    h = fingerprint_parts(d).first()
    many = spark.range(200).select(F.lit("x").alias("a"))
    assert fingerprint_parts(many).first().hash_sum == h.hash_sum * 200 % (1 << 61)


def test_stage_store(spark, tmp_path):
    from tablesmith.sources import store
    d = spark.range(5)
    assert store.lookup(spark, str(tmp_path), "s", "f") is None
    store.save(d, str(tmp_path), "s", "f", "")
    assert store.lookup(spark, str(tmp_path), "s", "f").count() == 5
    assert [tuple(r) for r in store.list_stages(spark, str(tmp_path)).collect()] == [("s", "f")]
    store.invalidate(spark, str(tmp_path), "s", "f")
    assert store.lookup(spark, str(tmp_path), "s", "f") is None and store.list_stages(spark, str(tmp_path)).count() == 0


def test_quantiles_of_large_columns_match_the_buffer(spark):
    """More rows than the brackets keep whole: ties, both ends, and a constant column."""
    from tablesmith.operators.quantiles import quantile_table
    d = spark.range(250_000).selectExpr("pmod(id * 7919, 250007) / 3.0 AS a", "pmod(id, 7) * 1.0 AS b", "2.5 AS c",
                                        "CASE WHEN id % 3 > 0 THEN pow(pmod(id * 31, 1009), 3) END AS d")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    want = {(r.column, r.p): r.value for r in d.agg(*[F.percentile(x, probs).alias(x) for x in d.columns]).unpivot([], d.columns, "column", "vs")
            .select("column", F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("p"), F.col("vs").alias("value"))).alias("z"))
            .select("column", "z.p", "z.value").collect()}
    got = {(r.column, r.p): r.value for r in quantile_table(d, d.columns, probs).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)


def test_prefix_sums(spark):
    from pyspark.sql import functions as F
    from tablesmith.operators.common import prefix_sums
    rows = [(g, i, (i * 7) % 5) for g in ("a", None, "b") for i in range(40)]
    d = spark.createDataFrame(rows, "g string, i int, w long").repartition(6)
    got = {(r.g, r.i): r.s for r in prefix_sums(d, ["g"], "i", {"s": F.col("w")}).collect()}
    assert got == {(g, i): sum((j * 7) % 5 for j in range(i)) for g, i, _ in rows}


def test_flow_carries_out_its_settings(spark):
    """Scaling, normalisation and every balancing method of a caller reach the rows."""
    from tablesmith.plans import preprocess as PP
    rows = [(i, float(i // 2), float((i * 7) % 11) if i % 9 else None, "a" if i % 4 else "b") for i in range(400)]
    d = spark.createDataFrame(rows, "_rid long, x double, y double, klass string")
    plan = spark.createDataFrame([("y", "knn")], "column string, missing string")
    for how in ("undersample", "oversample", "smote", "adasyn"):
        res = PP.preprocess_dynamic(d, "klass", override=plan, settings={"scaling": "quantile", "balancing": how, "normalization": "l2"})
        got = res.data.cache()
        n = {r["klass"]: r["count"] for r in got.where("_split = 'train'").groupBy("klass").count().collect()}
        assert n["a"] == n["b"] == (80 if how == "undersample" else 240)
        assert got.where("_split = 'test'").count() == 80 and got.where("y IS NULL").count() == 0
        assert got.where("abs(x * x + y * y - 1) > 1e-6 AND x * x + y * y > 0 AND _copy = 0").count() == 0
        steps = {r.step: (r.status, r.detail) for r in PP.step_status(spark, res).collect()}
        assert steps["balance"] == ("success", how) and steps["validate"] == ("success", "")
        got.unpersist()


def test_adasyn_makes_the_rows_it_allots(spark):
    """the query ended at the allocation.  Each row has n_i points on the way to one of its class's nearest."""
    import numpy as np
    from tablesmith import catalog
    from tablesmith.operators import knn as NN
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4)) + np.repeat([[0.0], [1.0], [40.0]], [40, 14, 6], axis=0)
    y = ["a"] * 40 + ["b"] * 14 + ["c"] * 6
    rows = [(k, v.tolist(), t) for k, (v, t) in enumerate(zip(x, y, strict=True))] + [(60 + k, [0.5 * k] * 4, None) for k in range(50)]
    df = NN.to_vectors(spark.createDataFrame(rows, "_rid long, emb array<double>, y string"), array_col="emb")
    got = NN.adasyn_samples(df, "y", k=3).collect()
    own, made = ([r for r in got if r.synthetic == s] for s in (False, True))
    assert sorted(r.id for r in own) == list(range(60)) and all(r.features == x[r.id].tolist() and r["class"] == y[r.id] for r in own)
    assert {t: sum(r["class"] == t for r in got) for t in "abc"} == {"a": 40, "b": 40, "c": 40}
    assert {r.id: r.n_i for r in own} == {k: sum(r.id == k for r in made) for k in range(60)}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = {k: [j for j in np.argsort(d[k], kind="stable") if j != k][:3] for k in range(60)}
    assert all(math.isclose(r.r, np.mean([y[j] != y[r.id] for j in near[r.id]])) for r in got)
    for r in made:
        mates = [j for j in np.argsort(d[r.id], kind="stable") if j != r.id and y[j] == y[r.id]][:3]
        step = np.array(r.features) - x[r.id]
        at = [step @ (x[j] - x[r.id]) / d[r.id, j] ** 2 for j in mates]
        assert any(0 <= t <= 1 and np.allclose(step, t * (x[j] - x[r.id])) for t, j in zip(at, mates, strict=True))
    catalog.load_all()
    n = {s: c for s, c in catalog.QUERIES["adasyn"](spark, SF_SMALL).groupBy("synthetic").count().collect()}
    assert n[False] > 0 and n[True] > 0


def test_context_has_the_first_different_values(spark, monkeypatch):
    """a column of few values gave the same one five times."""
    from tablesmith.operators import sample as D
    from tablesmith.plans import column_plan as L
    monkeypatch.setattr(D, "HEAD_ROWS", 4)      # so that the first rows do not hold the later values
    rows = [(k, "ab"[k >= 100], k // 2, None if k < 150 else f"s{k // 7}", "yx"[k % 2]) for k in range(300)]
    df = spark.createDataFrame(rows, "_rid long, late string, pair int, gaps string, y string").repartition(5)
    got = {r["column"]: (r["sample_values"], r["is_target"]) for r in L.planner_context(df, "y", 3).collect()}
    assert got == {"late": ("a,b", False), "pair": ("0,1,2", False), "gaps": ("s21,s22,s23", False), "y": ("y,x", True)}
    assert {r["column"]: r["sample_values"] for r in L.evidence(df, "y", 3).collect()}["late"] == "a,a,a"


def test_static_flow_treats_outliers_and_dates(spark, monkeypatch):
    """the default policy kept every outlier and took dates for categories, so these steps had nothing to do."""
    import datetime
    from tablesmith.catalog import plan_q
    from tablesmith.plans import column_plan as L
    from tablesmith.plans import preprocess as PP
    day = datetime.datetime(2020, 1, 1)
    rows = [(k, *[float((k * m) % 41) for m in (3, 5, 7)], float(k % 9), day + datetime.timedelta(days=k % 90), "ab"[k % 2]) for k in range(400)]
    rows += [(400 + k, 1e4, 5.0, 1e4, 0.5 * k, None, "a") for k in range(3)] + [(500 + k, 7.0, 1e4, 5.0, 0.5 * k, None, "b") for k in range(3)]
    df = spark.createDataFrame(rows, "_rid long, l_quantity double, l_discount double, l_tax double, plain double, day timestamp_ntz, l_returnflag string")
    asked = L.plan_from_rows(spark, [{"column": "l_quantity", "outlier": "clip"}, {"column": "l_discount", "outlier": "drop_rows"},
                                     {"column": "l_tax", "outlier": "log_transform"}, {"column": "plain", "outlier": "bogus"}])
    res = PP.preprocess_static(df, "l_returnflag", asked=asked, scaling="none", fit_scope="all")
    got = {r["_rid"]: r for r in res.data.collect()}
    assert set(got) == {*range(400), 400, 401, 402}                     # the rows far off in l_discount went
    assert max(r["l_quantity"] for r in got.values()) < 100 and math.isclose(got[400]["l_tax"], math.log1p(1e4))
    assert (got[31]["day__year"], got[31]["day__month"], got[31]["day__day"]) == (2020, 2, 1) and got[7]["plain"] == 7.0
    assert dict((s, d) for s, _, d in res.steps)["outliers"] == "clip=1 drop_rows=1 log=1"
    seen = []
    monkeypatch.setattr(PP, "preprocess_static", lambda *a, real=PP.preprocess_static, **k: (seen.append(real(*a, **k)), seen[-1])[1])
    out = plan_q.preprocess_static(spark, SF_SMALL)
    clip, drop, log = (int(x.split("=")[1]) for x in dict((s, d) for s, _, d in seen[0].steps)["outliers"].split())
    assert clip and drop and log and {"l_shipdate__year", "l_shipdate__month", "l_shipdate__day"} <= set(out.columns)


def test_scoped_tables_are_deleted(spark):
    import os
    from tablesmith.session import checkpoint, scoped_tables
    with scoped_tables(spark):
        path = checkpoint(spark.range(3)).inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert os.path.exists(path)
    assert not os.path.exists(path)
