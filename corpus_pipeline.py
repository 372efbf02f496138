"""The corpus pipeline: five operators over ``documents``, each stage's result written as
Parquet and read again as the next one's input; a stage's folder goes once the next is written.

A stage is a function (spark, docs, sf_dir) -> DataFrame.  All but the last return the columns
of documents; the last returns token ids.  ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm import decontam, lines, quality, simhash, spm
from tablesmith.llm.common import read
from tablesmith.session import ensure_checkpoint_dir, scoped_tables


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 go."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels"), ~held_out), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in two documents stay in the first only."""
    out = lines.dedup(docs, min_docs=2, min_chars=10)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.dedup(docs, shingle=3, bits=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"), n=10)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left."""
    return spm.encode(docs)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup),
          ("SimHash near-dedup", simhash_near_dedup), ("benchmark decontamination", benchmark_decontamination),
          ("SentencePiece encoding and decoding", sentencepiece_encoding)]

#: neither the classifier's trees, XXH64 fingerprints nor the encoding are expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scoped_tables(spark):      # a stage's intermediate tables go once its result is written
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:                           # the input of a written stage is not read again
            delete(spark, f"{root}/{k - 1}")
    return docs


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
