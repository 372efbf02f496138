"""Whole-table preparation under a plan (K-11 static, K-12 dynamic).

Each step is a DataFrame → DataFrame function; the only jobs that run before the final
write are the small fit aggregates (class counts, medians/modes, fences, category lists,
scaler moments), each over the training rows.  ``_split`` travels with the rows, so no
positional re-alignment of X and y is ever needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import c
from ..operators import encode as E
from ..operators import impute as N
from ..operators import outliers as O
from ..operators import sample as D
from ..operators import scale as K
from ..operators import balance as B
from ..operators.common import materialize_small, param_rows
from ..operators.knn import adasyn, impute_knn, smote, to_vectors
from ..operators.ready import readiness
from ..session import checkpoint
from . import column_plan as L


@dataclass
class Prepared:
    data: DataFrame                 # transformed rows with _rid, _split and the target
    plan: DataFrame                 # final column plan
    steps: list = field(default_factory=list)   # (step, status, detail)
    target: str = ""


def _numeric_features(df: DataFrame, target: str) -> list[str]:
    from pyspark.sql import types as T
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name != target and not f.name.startswith("_")]


def preprocess_dynamic(df: DataFrame, target: str, override: DataFrame | None = None,
                       constraints: DataFrame | None = None, test_size: float = 0.2, seed=42,
                       quantiles: str = "exact", settings: dict | None = None) -> Prepared:
    """Ten steps: inspect → plan → split → missing → outliers → encode → scale →
    normalise → balance, and ``validate`` on the result.  Every fit uses train rows only.
    ``settings`` overrides the table-level choices (scaling, normalization, balancing)."""
    chosen = settings or {}
    steps = []
    ev = materialize_small(L.evidence(df, target))
    tev = materialize_small(L.target_evidence(df, target, duplicates=False))
    plan = L.default_plan(ev)
    if override is not None:
        plan = L.validate_plan(L.merge_plan(plan, override), L.default_plan(ev))
    if constraints is not None:
        plan = L.apply_constraints(plan, constraints)
    rows = {r["column"]: r.asDict() for r in param_rows(plan)}
    t = tev.first().asDict()
    settings = {**param_rows(L.plan_settings(tev))[0].asDict(), **chosen}
    steps.append(("inspect", "success", f"{len(rows)} columns"))
    steps.append(("plan", "success", settings["balancing"]))

    # split: duplicates, missing target, planned drops, stratified when possible
    feats = [k for k, r in rows.items() if not r["drop"]]
    dropped = [k for k, r in rows.items() if r["drop"]]
    data = D.dedupe_exact(df, [n for n in df.columns if not n.startswith("_")])
    data = checkpoint(data.where(c(target).isNotNull()).drop(*dropped))
    if t["task_type"] == "classification":
        data = D.split_stratified(data, target, test_size, seed)
    else:
        data = D.split_random(data, test_size, seed)
    # every fit below scans the split table: one write is cheaper than hashing the keys again in each
    data = checkpoint(data)
    steps.append(("split", "success", f"dropped={','.join(sorted(dropped))}"))

    # missing values
    knn = [k for k in feats if rows[k]["missing"] == "knn" and rows[k]["type"] == "numeric"]
    if knn:
        data = checkpoint(impute_knn(data, knn))
    methods = {k: rows[k]["missing"] for k in feats if rows[k]["missing"] not in ("none", "drop_rows", "knn")}
    drop_rows = [k for k in feats if rows[k]["missing"] == "drop_rows"]
    if drop_rows:
        data = N.drop_rows_missing(data, drop_rows)
    if methods:
        data = N.apply_impute(data, N.fit_impute(data, methods, quantiles))
    steps.append(("missing", "success", f"{len(methods) + len(knn)} columns"))

    # outliers
    clip = [k for k in feats if rows[k]["outlier"] == "clip_iqr" and rows[k]["type"] == "numeric"]
    remove = [k for k in feats if rows[k]["outlier"] == "remove_rows"]
    logt = [k for k in feats if rows[k]["outlier"] == "log_transform"]
    if clip:
        data = O.apply_clip(data, O.fit_bounds(data, clip, "iqr", quantiles))
    if remove:
        data = O.remove_outlier_rows(data, O.fit_bounds(data, remove, "iqr", quantiles))
    if logt:
        data = O.signed_log(data, logt)
    steps.append(("outliers", "success", f"clip={len(clip)} remove={len(remove)} log={len(logt)}"))

    # encoding
    onehot = [k for k in feats if rows[k]["encoding"] == "onehot"]
    label = [k for k in feats if rows[k]["encoding"] in ("label", "ordinal")]
    freq = [k for k in feats if rows[k]["encoding"] == "frequency"]
    if freq:
        data = E.apply_frequency(data, E.fit_frequency(data, freq))
    if label:
        data = E.apply_label(data, E.fit_label(data, label))
    if onehot:
        data = E.apply_onehot(data, E.fit_onehot(data, onehot))
    steps.append(("encode", "success", f"onehot={len(onehot)} label={len(label)} frequency={len(freq)}"))

    # scaling: every numeric feature column after encoding, except skipped ones
    skip = {k for k, r in rows.items() if r["skip_scaling"]}
    num = [x for x in _numeric_features(data, target) if x not in skip]
    scale = settings["scaling"] if num else "none"
    data = scaled(data, num, scale, quantiles)
    steps.append(("scale", done(scale), scale))
    norm = settings["normalization"] if num else "none"
    if norm != "none":
        data = K.normalize_rows(data, num, norm)
    steps.append(("normalize", done(norm), norm))
    data = balanced(data, target, settings["balancing"], seed)
    steps.append(("balance", done(settings["balancing"]), settings["balancing"]))
    return Prepared(data, plan, steps, target)


def done(method: str) -> str:
    return "skipped" if method == "none" else "success"


def scaled(data: DataFrame, cols: list[str], method: str, quantiles: str = "exact") -> DataFrame:
    """K-1 to K-5 by name, fitted on train rows."""
    if method == "none" or not cols:
        return data
    if method == "quantile":
        return K.apply_quantile(data, K.fit_quantile(data, cols))
    if method == "power":
        return K.apply_power(data, K.fit_power(data, cols))
    return K.apply_scaler(data, K.fit_scaler(data, cols, method, quantiles))


def balanced(data: DataFrame, target: str, method: str, seed=42) -> DataFrame:
    """B-1 to B-6 by name.  Re-sampling touches the train rows only; made rows (copies and synthetic rows)
    are marked in ``_copy``, synthetic ones have no ``_rid``."""
    if method == "none":
        return data
    if method == "class_weight":
        return B.class_weights(data, target)
    has_split = "_split" in data.columns
    train = data.where(F.col("_split") == "train") if has_split else data
    rest = data.where(F.col("_split") != "train").withColumn("_copy", F.lit(0).cast("long")) if has_split else None
    if method == "undersample":
        out = B.undersample(train, target, seed).withColumn("_copy", F.lit(0).cast("long"))
    elif method == "oversample":
        out = B.oversample(train, target, seed)
    elif method in ("smote", "adasyn"):
        out = synthesized(train, target, method, seed)
    else:
        raise ValueError(f"unknown balancing method {method}")
    return out if rest is None else out.unionByName(rest)


def synthesized(train: DataFrame, target: str, method: str, seed) -> DataFrame:
    """The rows of ``train`` and synthetic rows between neighbours; every feature must be numeric."""
    cols = [x for x in train.columns if not x.startswith("_") and x != target]
    other = [x for x in cols if x not in _numeric_features(train, target)]
    if other:
        raise ValueError(f"{method} needs numeric features; encode {sorted(other)} first")
    known = train.where(c(target).isNotNull())
    wide = known.select("_rid", target, F.array(*[F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in cols]).alias("_x"))
    made = (smote if method == "smote" else adasyn)(to_vectors(wide, array_col="_x"), target, seed=seed).where("synthetic")
    extra = [F.lit("train").alias(x) if x == "_split" else F.lit(None).cast(train.schema[x].dataType).alias(x)
             for x in train.columns if x.startswith("_")]
    made = made.select(c(target), *[F.get("features", F.lit(i)).alias(x) for i, x in enumerate(cols)], *extra,
                       F.lit(1).cast("long").alias("_copy"))
    kept = train.select(*[c(x).cast("double").alias(x) if x in cols else c(x) for x in train.columns],
                        F.lit(0).cast("long").alias("_copy"))
    return kept.unionByName(made)


def validate(prepared: Prepared) -> tuple[bool, str]:
    """V-1: whether the prepared table is ready for training, and what blocks it otherwise."""
    blockers = [(r["column"], r["blocker"]) for r in
                param_rows(readiness(prepared.data, prepared.target).where("blocker IS NOT NULL"))]
    return not blockers, ", ".join(f"{x}: {b}" for x, b in sorted(blockers))


def preprocess_static(df: DataFrame, target: str, policy: DataFrame | None = None,
                      fit_scope: str = "train", test_size: float = 0.2, seed=42,
                      scaling: str = "standard", normalization: str = "none",
                      selection: str = "none", reduction: str = "none", quantiles: str = "exact",
                      asked: DataFrame | None = None) -> Prepared:
    """K-11: duplicates → per-column (drop, convert, impute, outlier, datetime, encode) →
    capped row drop → select (``variance``: columns of one value go) → scale → normalise →
    reduce (``pca`` to the square root of the number of columns), with step status.  ``fit_scope='all'``
    fits on the whole table as the static path does; the default fits on train rows, split by class where the
    target is one, numeric or not.  ``policy`` is taken as it is; ``asked`` is laid over the default policy, which
    leaves outliers as they are."""
    from pyspark.sql import types as T
    steps = []
    ev = materialize_small(L.evidence(df, target, static=True))
    isnum = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    pol = policy if policy is not None else L.static_policy(ev, isnum, asked)
    rows = {r["column"]: r.asDict() for r in param_rows(pol)}
    data = D.dedupe_exact(df, [n for n in df.columns if not n.startswith("_")])
    steps.append(("duplicates", "success", "drop_exact"))
    dropped = [k for k, r in rows.items() if r["drop"]]
    data = data.drop(*dropped)
    feats = [k for k, r in rows.items() if not r["drop"]]
    # the task, the split's counts and its cut all read the de-duplicated rows
    data = checkpoint(E.convert_types(data, {k: rows[k]["type"] for k in feats}))
    if fit_scope == "train":
        task = L.target_evidence(data, target, duplicates=False).first()["task_type"]
        data = checkpoint(D.split_stratified(data, target, test_size, seed) if task == "classification" else
                          D.split_random(data, test_size, seed))
    methods = {k: rows[k]["missing"] for k in feats}
    data = N.apply_impute(data, N.fit_impute(data, methods, quantiles))
    steps.append(("impute", "success", f"{len(methods)} columns"))
    clip = [k for k in feats if rows[k]["outlier"] == "clip" and rows[k]["type"] == "numeric"]
    if clip:
        data = O.apply_clip(data, O.fit_bounds(data, clip, "quantile", quantiles))
    dr = [k for k in feats if rows[k]["outlier"] == "drop_rows" and rows[k]["type"] == "numeric"]
    if dr:
        data = O.remove_outlier_rows_capped(data, O.fit_bounds(data, dr, "quantile", quantiles))
    logt = [k for k in feats if rows[k]["outlier"] == "log_transform"]
    if logt:
        data = O.signed_log(data, logt)
    steps.append(("outliers", "success", f"clip={len(clip)} drop_rows={len(dr)} log={len(logt)}"))
    dts = [k for k in feats if rows[k]["type"] == "datetime"]
    if dts:
        data = E.datetime_parts(data, dts)
    enc = {k: rows[k]["encoding"] for k in feats if rows[k]["type"] != "numeric" and rows[k]["type"] != "datetime"}
    oh = [k for k, v in enc.items() if v == "onehot"]
    lab = [k for k, v in enc.items() if v == "label"]
    fq = [k for k, v in enc.items() if v == "frequency"]
    hs = [k for k, v in enc.items() if v == "hash"]
    if fq:
        data = E.apply_frequency(data, E.fit_frequency(data, fq), suffix="__freq")
    if lab:
        data = E.apply_label(data, E.fit_label(data, lab))
    if oh:
        data = E.apply_onehot(data, E.fit_onehot(data, oh), sep="_")
    if hs:
        data = E.hash_encode(data, hs)
    steps.append(("encode", "success", f"onehot={len(oh)} label={len(lab)} frequency={len(fq)} hash={len(hs)}"))
    num = _numeric_features(data, target)
    if selection == "variance":
        data = checkpoint(data)
        gone = [r["column"] for r in param_rows(K.constant_columns(data, num))] if num else []
        data, num = data.drop(*gone), [x for x in num if x not in gone]
        steps.append(("select", "success", ",".join(sorted(gone))))
    else:
        steps.append(("select", "skipped", selection))
    scaling = scaling if num else "none"
    data = scaled(data, num, scaling, quantiles)
    steps.append(("scale", done(scaling), scaling))
    if normalization != "none" and num:
        data = K.normalize_rows(data, num, normalization)
    steps.append(("normalize", done(normalization if num else "none"), normalization))
    if reduction == "pca" and len(num) > 2:
        data = K.pca_reduce(checkpoint(data), num)
        steps.append(("reduce", "success", f"{len(num)} columns"))
    else:
        steps.append(("reduce", "skipped" if reduction == "none" else "skipped_not_enough_features", reduction))
    return Prepared(data, pol, steps, target)


def step_status(spark, prepared: Prepared) -> DataFrame:
    """(step, status, detail): the steps taken, and the outcome of ``validate`` on the result."""
    ready, why = validate(prepared)
    steps = [*prepared.steps, ("validate", "success" if ready else "blocked", why)]
    return spark.createDataFrame(steps, "step string, status string, detail string")
