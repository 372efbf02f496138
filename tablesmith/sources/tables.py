"""Readers for the provided parquet tables and the deterministic "dirty" views the
checks use.

All provided tables are free of gaps, so gaps, outliers and copies are injected by
fixed rules on the key (never by dropping rows).  Each view is one SQL text that
Spark and DuckDB both run, so the Spark query and its oracle see identical input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# The injection rules of the test views.
VIEW_SQL = {
    # lineitem with gaps, outliers and a nullable category; (orderkey, linenumber) is not
    # unique in the generated data, so _rid is a 60-bit md5 of six columns
    "li": """
        SELECT CAST(conv(substr(md5(concat_ws(':', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
                                          CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
                                          CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING),
                                          CAST(CAST(round(l_quantity * 100) AS BIGINT) AS STRING))), 1, 15), 16, 10) AS BIGINT) AS _rid,
               l_orderkey, l_partkey, l_suppkey, l_linenumber,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
               CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS l_extendedprice,
               l_discount,
               CASE WHEN l_orderkey % 17 = 3 THEN NULL ELSE l_tax END AS l_tax,
               l_returnflag,
               CASE WHEN l_orderkey % 19 = 5 THEN NULL ELSE l_linestatus END AS l_linestatus,
               CASE WHEN l_orderkey % 23 = 7 THEN NULL ELSE l_shipdate END AS l_shipdate
        FROM lineitem""",
    # li plus exact copies of every 50th order, with a _rid of their own, and of every 70th, with the same _rid
    "li_dup": """
        SELECT * FROM li
        UNION ALL
        SELECT _rid + 1000000000000 AS _rid, l_orderkey, l_partkey, l_suppkey, l_linenumber,
               l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
        FROM li WHERE l_orderkey % 50 = 0
        UNION ALL
        SELECT * FROM li WHERE l_orderkey % 70 = 0""",
    # documents with their (partly missing) labels: natural gaps in the target
    "docs": """
        SELECT d.doc_id AS _rid, d.doc_id, d.lang, d.source, d.n_chars,
               length(d.text) AS text_len, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # orders with a numeric-looking string and NA tokens
    "ord": """
        SELECT o_orderkey AS _rid, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               o_orderdate, o_orderpriority,
               CASE WHEN o_orderkey % 13 = 0 THEN '?' ELSE CAST(o_custkey % 1000 AS STRING) END AS o_code
        FROM orders""",
    # events with the JSON property pulled out
    "ev": """
        SELECT event_id AS _rid, event_id, ts, user_id, event_type, value,
               get_json_object(props, '$.k') AS prop_k
        FROM events""",
}

# DuckDB spelling of the few functions whose names differ.
_DUCK_REWRITE = {"get_json_object(props, '$.k')": "json_extract_string(props, '$.k')",
                 "CAST(conv(substr(md5(": "('0x' || substr(md5(",
                 "), 1, 15), 16, 10) AS BIGINT)": "), 1, 15))::BIGINT"}


def view_sql_duckdb(name: str) -> str:
    sql = VIEW_SQL[name]
    for a, b in _DUCK_REWRITE.items():
        sql = sql.replace(a, b)
    return sql


def with_views(sql: str, *names: str) -> str:
    """Prefix a DuckDB query with the CTEs of the named views (dependencies first)."""
    order = []
    for n in names:
        if n == "li_dup" and "li" not in order:
            order.append("li")
        if n not in order:
            order.append(n)
    ctes = ",\n".join(f"{n} AS ({view_sql_duckdb(n)})" for n in order)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


SPREAD_FROM = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scanned table dealt evenly to all cores where its files are too few for that: a row group is read by one
    task, however many cores there are.  Only tables of under one input split a core are dealt (a shuffle of all
    their rows, after column pruning and filters); larger ones are read as they are, and tables of under
    ``SPREAD_FROM`` bytes are not worth it.  The size is the files', taken from the plan without a job."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if SPREAD_FROM <= size < cores * split else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    for n in names or TABLES:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


_BASE = {"li": ["lineitem"], "li_dup": ["lineitem"], "docs": ["documents", "labels"],
         "ord": ["orders"], "ev": ["events"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test view as a DataFrame (lazy; Catalyst prunes and pushes through it)."""
    if name not in VIEW_SQL:
        return read_table(spark, sf_dir, name)
    register_tables(spark, sf_dir, _BASE[name])
    if name == "docs":      # as its SQL, but texts are measured before the join, so only their lengths are shuffled
        d = spark.table("documents").select("doc_id", "lang", "source", "n_chars", F.length("text").alias("text_len"))
        return d.join(spark.table("labels"), "doc_id", "left").select(
            F.col("doc_id").alias("_rid"), "doc_id", "lang", "source", "n_chars", "text_len", "quality", "toxic")
    if name == "li_dup":
        spark.sql(VIEW_SQL["li"]).createOrReplaceTempView("li")
    return spark.sql(VIEW_SQL[name])
