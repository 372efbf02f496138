"""DuckDB oracle per SQL-checkable query (the driver's gate, on a fast subset plus the
flagship), compared exactly after the shared final quantisation."""

import hashlib
import math

import pytest

import __spark_entry__ as E
from conftest import SF_CHECK

FAST = ["schema_extract", "column_types", "dataset_summary", "duplicate_rows", "missing_profile", "distinct_profile",
        "numeric_profile", "skew_kurt", "iqr_outliers", "jarque_bera", "top_values", "datetime_range", "low_variance",
        "mixed_parse_classes", "feature_scale", "split_stratified", "split_random", "kfold_assign", "impute_median",
        "impute_mode", "clip_iqr", "onehot", "label_encode", "frequency_encode", "scale_standard", "scale_robust",
        "normalize_l2", "strong_pairs", "corr_matrix", "cramers_v", "anova_f", "target_classification",
        "suggest_target", "chart_histogram", "metric_f1", "confusion_matrix", "roc_curve", "auc",
        "recipe_generate", "recipe_validate", "plan_default_dynamic", "plan_constraints", "evidence_dynamic",
        "class_weights", "undersample", "na_tokens", "safe_numeric", "sanitize_floats", "training_plan",
        "preprocess_dynamic"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


def test_every_oracle_name_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_no_forbidden_query_names():
    for n in E.catalog.QUERIES:
        assert "pipeline" not in n and not n.startswith("op")


@pytest.mark.parametrize("name", FAST)
def test_matches_duckdb(spark, duck, name):
    df = E.queries()[name](spark, SF_CHECK)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)
