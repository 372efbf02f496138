"""Content fingerprints and the stage result store (H-1, H-2).

The fingerprint is order-free: a sum and a bit-xor of per-row hashes plus the row count
and the schema, combined with the target by sha2.  Two copies of a table with rows in a
different order or partitioning get the same fingerprint.  Stage results are Parquet
under ``<root>/stage=<name>/fingerprint=<fp>/data``.  Beside it a manifest (version, stage, target,
fingerprint, schema, rows) is written last and moved into place in one step; a lookup reads only
data whose manifest is there and agrees with it, so neither a half-written nor an outdated result
is taken for a stored one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import c

STORE_VERSION = "2"


def row_hash_md5(df: DataFrame, cols: list[str] | None = None):
    """63-bit row hash from md5 of the '|'-joined values (the SQL-checkable form)."""
    cols = cols or [x for x in df.columns if not x.startswith("_")]
    s = F.concat_ws("|", *[F.coalesce(c(x).cast("string"), F.lit("\\N")) for x in cols])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


def fingerprint_parts(df: DataFrame, cols: list[str] | None = None, fast: bool = False) -> DataFrame:
    """One row: n_rows, hash_sum (modulo 2^61; summed as a decimal, so no row count overflows it), hash_xor."""
    cols = cols or [x for x in df.columns if not x.startswith("_")]
    h = F.xxhash64(*[c(x) for x in cols]) if fast else row_hash_md5(df, cols)
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                                       (F.sum(F.col("h").cast("decimal(38,0)")) % F.lit(1 << 61)).cast("long").alias("hash_sum"),
                                       F.bit_xor("h").alias("hash_xor"))


def fingerprint(df: DataFrame, target: str = "", cols: list[str] | None = None, fast: bool = False) -> DataFrame:
    """H-1: one row with the parts and the combined sha2 fingerprint."""
    cols = cols or [x for x in df.columns if not x.startswith("_")]
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields if f.name in cols)
    p = fingerprint_parts(df, cols, fast)
    key = F.concat_ws("|", F.lit(STORE_VERSION), F.lit(schema), F.lit(target), F.col("n_rows").cast("string"),
                      F.col("hash_sum").cast("string"), F.col("hash_xor").cast("string"))
    return p.withColumn("fingerprint", F.substring(F.sha2(key, 256), 1, 16))


def stage_path(root: str, stage: str, fp: str) -> str:
    return f"{root.rstrip('/')}/stage={stage}/fingerprint={fp}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifest_path(root: str, stage: str, fp: str) -> str:
    return f"{stage_path(root, stage, fp)}/manifest.json"


def read_manifest(spark: SparkSession, root: str, stage: str, fp: str) -> dict | None:
    """What a finished write left; None if there is none or it is not readable as such."""
    fs, path = _file_system(spark, _manifest_path(root, stage, fp))
    if not fs.exists(path):
        return None
    text = spark.read.option("wholetext", True).text(path.toString()).first()[0]     # one small file
    try:
        return json.loads(text)
    except ValueError:
        return None


def lookup(spark: SparkSession, root: str, stage: str, fp: str, target: str = "") -> DataFrame | None:
    """H-2: a stored stage result, or None when it is absent, half-written, of another version, fingerprint or
    target, or when its data no longer have the schema and rows that were stored."""
    m = read_manifest(spark, root, stage, fp)
    if m is None or (m.get("version"), m.get("stage"), m.get("fingerprint"), m.get("target")) != (STORE_VERSION, stage, fp, target):
        return None
    data = f"{stage_path(root, stage, fp)}/data"
    fs, path = _file_system(spark, f"{data}/_SUCCESS")
    if not fs.exists(path):
        return None
    df = spark.read.parquet(data)
    same = json.loads(df.schema.json()) == m["schema"]
    return df if same and df.count() == m["rows"] else None


def save(df: DataFrame, root: str, stage: str, fp: str, target: str = "") -> str:
    """Write a stage result, then its manifest; an older manifest goes first."""
    spark, path = df.sparkSession, stage_path(root, stage, fp)
    fs, old = _file_system(spark, _manifest_path(root, stage, fp))
    fs.delete(old, False)
    df.write.mode("overwrite").parquet(f"{path}/data")
    back = spark.read.parquet(f"{path}/data")
    m = {"version": STORE_VERSION, "stage": stage, "target": target, "fingerprint": fp,
         "schema": json.loads(back.schema.json()), "rows": back.count()}
    _, new = _file_system(spark, f"{path}/manifest.json.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(m).encode()))
    out.close()
    if not fs.rename(new, old):
        raise OSError(f"could not move the manifest of {path} into place")
    return path


def reuse_or_compute(spark: SparkSession, root: str, stage: str, fp: str, compute, target: str = "") -> tuple[DataFrame, bool]:
    """Read the stage if stored for this fingerprint and target, else compute, store and re-read."""
    got = lookup(spark, root, stage, fp, target)
    if got is not None:
        return got, True
    save(compute(), root, stage, fp, target)
    return spark.read.parquet(f"{stage_path(root, stage, fp)}/data"), False


def list_stages(spark: SparkSession, root: str) -> DataFrame:
    """(stage, fingerprint) of everything finished under ``root``."""
    fs, path = _file_system(spark, f"{root.rstrip('/')}/stage=*/fingerprint=*/manifest.json")
    found = [str(x.getPath().getParent()) for x in (fs.globStatus(path) or [])]
    rows = [tuple(part.split("=", 1)[1] for part in p.rsplit("/", 2)[-2:]) for p in found]
    return spark.createDataFrame(rows, "stage string, fingerprint string")


def invalidate(spark: SparkSession, root: str, stage: str, fp: str) -> None:
    """Remove a stored stage (Hadoop FileSystem, works on any cluster file system)."""
    fs, path = _file_system(spark, stage_path(root, stage, fp))
    fs.delete(path, True)
