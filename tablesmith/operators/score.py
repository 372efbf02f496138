"""Batch scoring and schema alignment (PF-9, PF-10, Z-1, Z-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import c


def align_features(df: DataFrame, model_columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """PF-9: the model's training columns in their order; missing → 0, NULL → 0, extra
    columns dropped (``keep`` columns such as ``_rid`` pass through)."""
    have = set(df.columns)
    out = [c(k) for k in (keep or []) if k in have]
    out += [F.coalesce(c(x), F.lit(0)).alias(x) if x in have else F.lit(0).alias(x) for x in model_columns]
    return df.select(out)


def guard_alignment(train: DataFrame, test: DataFrame) -> DataFrame:
    """PF-10: (check, ok, detail) — same columns in the same order."""
    same = train.columns == test.columns
    detail = "" if same else f"train={train.columns} test={test.columns}"
    return train.sparkSession.createDataFrame([("same_columns", same, detail)], "check string, ok boolean, detail string")


def feature_schema(df: DataFrame, features: list[str]) -> DataFrame:
    """Z-2: (feature, dtype) of a model's training table."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name in features]
    return df.sparkSession.createDataFrame(rows, "feature string, dtype string")


def batch_score(df: DataFrame, model, model_columns: list[str], keep: list[str] = ("_rid",)) -> DataFrame:
    """Z-1: align → assemble → ``model.transform`` as one distributed job (no label needed)."""
    from pyspark.ml.feature import VectorAssembler
    from .train import FEATURES
    aligned = align_features(df, model_columns, list(keep))
    va = VectorAssembler(inputCols=model_columns, outputCol=FEATURES, handleInvalid="keep")
    scored = model.transform(va.transform(aligned))
    return scored.select(*[c(k) for k in keep], "prediction")
