"""Four-stage flow (H-3): raw profile → preparation → clean profile → training.

Every stage's result is a table in the stage store (``sources.store``), keyed by the input's content
and target, and the next stage reads it from there.  A stage that fails stops the flow with an
error that names it; running the flow again takes the stages that were finished from the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import profile as P
from ..operators import train as M
from ..session import ensure_checkpoint_dir
from ..sources import store
from . import preprocess as PP
from .column_plan import target_evidence

MODELS = ("LogisticRegression", "RandomForest")


class StageFailed(RuntimeError):
    """The stage that failed, and the rows of those before it."""

    def __init__(self, stage: str, done: list[tuple]):
        super().__init__(f"stage {stage} failed")
        self.stage, self.done = stage, done


def column_report(df: DataFrame) -> DataFrame:
    """One row a column: missing and distinct values, and the moments, quartiles and outliers of numbers."""
    return P.missing_profile(df).join(P.distinct_profile(df), "column").join(P.numeric_profile(df), "column", "left")


def _train(data: DataFrame, target: str) -> DataFrame:
    features = [f.name for f in data.schema.fields
                if isinstance(f.dataType, T.NumericType) and not f.name.startswith("_") and f.name not in (target, "class_weight")]
    task = target_evidence(data, target, duplicates=False).first()["task_type"]
    if task == "classification":
        data = data.withColumn(target, F.col(target).cast("string"))
    return M.train_simple(data, target, features, task, models=MODELS, refit=False).leaderboard


def run_stages(df: DataFrame, target: str, root: str | None = None) -> DataFrame:
    """(stage, status, rows, detail): status is ``success`` for a stage that ran and ``reused`` for a stored one."""
    spark, done = df.sparkSession, []
    root = root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages"
    fp = store.fingerprint(df, target).first()["fingerprint"]

    def stage(name, compute):
        try:
            table, reused = store.reuse_or_compute(spark, root, name, fp, compute, target)
        except Exception as e:
            raise StageFailed(name, done) from e
        done.append([name, "reused" if reused else "success", table.count(), ""])
        return table

    stage("raw_profile", lambda: column_report(df))
    data = stage("preprocessing", lambda: PP.preprocess_dynamic(df, target).data)
    done[-1][3] = ",".join(sorted(x for x in data.columns if not x.startswith("_")))
    stage("clean_profile", lambda: column_report(data.drop("_split")))
    best = stage("training", lambda: _train(data, target)).orderBy(F.desc("score"), "model").first()
    done[-1][3] = f"best={best['model']}"
    return spark.createDataFrame([tuple(x) for x in done], "stage string, status string, rows long, detail string")
