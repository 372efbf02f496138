"""The registered queries: SQL where there is some, whole tables, and the pipeline step by step."""

from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from tablesmith.llm import queries

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = list(E.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted(tuple(r[k] for k in at) for r in cur.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == want


def test_pipeline_stages_on_odd_documents(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
            docs = spark.createDataFrame(out.collect(), docs.schema)
        else:
            assert out.count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0), SF).count() == 0


def test_pipeline_keeps_and_drops(spark):
    """Each stage's rows against its own operator's report on the same input."""
    from pyspark.sql import functions as F

    from tablesmith.llm import decontam, simhash
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, SF).collect()}
    assert ids == {r.doc_id for r in simhash.link(docs).where("doc_id = component_id").collect()}
    ids = {r.doc_id for r in corpus_pipeline.benchmark_decontamination(spark, docs, SF).collect()}
    clean = decontam.scan(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where(~F.col("contaminated"))
    assert ids == {r.doc_id for r in clean.collect()}
    out = corpus_pipeline.run(spark, SF)
    last = Path(urlparse(out.inputFiles()[0]).path).parent
    assert last.name == "4" and [p.name for p in last.parent.iterdir()] == ["4"]        # no copies of earlier stages stay
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and 0 < out.count() < docs.count()
