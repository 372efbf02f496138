"""Sources and sinks (IO-1 … IO-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import apply_na_tokens, c

READERS = {"csv", "parquet", "json"}
SAMPLE_ROWS = 5_000
RESCUED = "_rescued"


def sampled_schema(df: DataFrame, rows: int = SAMPLE_ROWS) -> T.StructType:
    """The types of a table of texts, from its first ``rows`` rows: a column is long, double, date, timestamp or
    boolean if all its values there read as such, else string."""
    d = df.limit(rows)
    kinds = ["bigint", "double", "date", "timestamp_ntz", "boolean"]
    shape = {"bigint": r"^[+-]?\d+$", "date": r"^\d{4}-\d{2}-\d{2}$", "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}.*$",
             "boolean": r"(?i)^(true|false)$"}
    checks = []
    for i, n in enumerate(df.columns):
        v = F.trim(c(n))
        for k in kinds:
            good = v.try_cast(k).isNotNull() & (v.rlike(shape[k]) if k in shape else F.lit(True))
            checks.append(F.coalesce(F.every(F.when(v.isNotNull() & (v != ""), good)), F.lit(False)).alias(f"{i}_{k}"))
    found = d.agg(*checks).first()      # one row
    fields = [T.StructField(n, T._parse_datatype_string(next((k for k in kinds if found[f"{i}_{k}"]), "string")))
              for i, n in enumerate(df.columns)]
    return T.StructType(fields)


def load_table(spark: SparkSession, path: str, fmt: str | None = None, na_tokens: list[str] | None = None,
               schema=None, rescued: str | None = None, multi_line: bool = False) -> DataFrame:
    """IO-1 / IO-3 / IO-4: reader chosen by extension; other formats raise.

    CSV has a header; without a ``schema`` the types come from the first ``SAMPLE_ROWS`` rows, so the file is not
    read twice.  JSON is a value a line, or with ``multi_line`` a value or array of values a file.  With
    ``rescued`` a column of that name holds the raw text of rows that do not fit the schema (their readable values
    stay), null for the others; without it such values are null.  Spark converts only the columns that a query
    reads, and finds only those unfit: write the table (``session.checkpoint``) before counting rescued rows."""
    ext = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if ext not in READERS:
        raise ValueError(f"unsupported format: {ext}")
    if ext == "parquet":
        df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
        return apply_na_tokens(df, na_tokens) if na_tokens else df
    csv = ext == "csv"
    r = spark.read.option("header", True) if csv else spark.read.option("multiLine", multi_line)
    if schema is None:
        schema = sampled_schema(r.csv(path)) if csv else r.json(path).schema
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    schema = T.StructType([f for f in schema.fields if f.name not in (rescued, "_corrupt_record")])
    r = r.option("mode", "PERMISSIVE")
    if rescued:
        schema = schema.add(rescued, "string")
        r = r.option("columnNameOfCorruptRecord", rescued)
    df = r.schema(schema).csv(path, enforceSchema=True) if csv else r.schema(schema).json(path)
    return apply_na_tokens(df, na_tokens) if na_tokens else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by=None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def save_split(df: DataFrame, folder: str, stage: str) -> str:
    """IO-5: one table per stage, partitioned by ``_split`` (train/test)."""
    return write_table(df, f"{folder.rstrip('/')}/{stage}", "parquet", partition_by="_split")


def load_split(spark: SparkSession, folder: str, stage: str, split: str | None = None) -> DataFrame:
    """IO-6: read a stage; a ``split`` filter prunes partitions."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{stage}")
    return df.where(F.col("_split") == split) if split else df


def rebuild_clean(train: DataFrame, test: DataFrame) -> DataFrame:
    """IO-7: the full clean table is the union of the splits (``_rid`` keeps identity)."""
    return train.unionByName(test, allowMissingColumns=True)


def write_report(tables: dict[str, DataFrame], folder: str, fmt: str = "json") -> list[str]:
    """IO-8: every tidy report table to its own folder."""
    return [write_table(df, f"{folder.rstrip('/')}/{name}", fmt) for name, df in tables.items()]


def export_transformed(df: DataFrame, folder: str, vector_col: str | None = None, names: list[str] | None = None) -> str:
    """IO-9: vector column → named numeric columns, then train / test / full tables."""
    if vector_col:
        from pyspark.ml.functions import vector_to_array
        arr = vector_to_array(vector_col)
        df = df.select(*[x for x in df.columns if x != vector_col],
                       *[arr[i].alias(n) for i, n in enumerate(names or [])])
    return write_table(df, f"{folder.rstrip('/')}/transformed", "parquet", partition_by="_split")


def save_model(model, path: str) -> str:
    """IO-10: MLlib writer (any cluster file system)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
