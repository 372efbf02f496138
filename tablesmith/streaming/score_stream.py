"""Applying fitted parameters and a model to a stream.

Every ``apply_*`` step is row-local (literals from the fitted parameter tables), so the
same preparation and a fitted MLlib model run unchanged on a Structured Streaming
DataFrame.  The sink is Parquet under the shared checkpoint folder with its own
streaming checkpoint, so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import impute as N
from ..operators import scale as K
from ..session import ensure_checkpoint_dir

FEATS = ["l_quantity", "l_discount", "l_tax"]


def fit_batch(train: DataFrame):
    """Fit imputation + scaling parameters and a regression model on a batch table."""
    imp = N.fit_impute(train, {x: "median" for x in FEATS})
    t1 = N.apply_impute(train, imp)
    sc = K.fit_scaler(t1, FEATS, "standard")
    t2 = K.apply_scaler(t1, sc)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol="features"),
                             LinearRegression(featuresCol="features", labelCol="l_extendedprice")]).fit(t2)
    return imp, sc, model


def score_stream(stream: DataFrame, imp: DataFrame, sc: DataFrame, model) -> DataFrame:
    """The streaming plan: impute → scale → predict (all row-local)."""
    return model.transform(K.apply_scaler(N.apply_impute(stream, imp), sc)).select(
        "l_orderkey", "l_returnflag", "prediction")


def score_stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the batch table, then score lineitem read as a file stream until all
    available input is processed (``availableNow``); returns a summary of the sink."""
    src = f"{sf_dir.rstrip('/')}/lineitem.parquet"
    batch = spark.read.parquet(src)
    imp, sc, model = fit_batch(batch)
    # a file stream watches a folder; the glob filter picks this table's files
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "lineitem*.parquet").parquet(sf_dir)
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    q = (score_stream(stream, imp, sc, model).writeStream.format("parquet")
         .option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"))
