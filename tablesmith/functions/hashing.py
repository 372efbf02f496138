"""Partition-independent randomness.

Every random choice in the library (splits, samples, folds, draws) is a function of
the row key and a seed, so the result does not depend on how Spark partitions the
data, a retried task gives the same answer, and the same number is computable in
plain SQL:

    u(key, seed) = conv(substr(md5(concat(seed, ':', key)), 1, 8), 16, 10) / 2^32
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(2 ** 32)


def hash_int(key: Column | str, seed: int | str) -> Column:
    """32-bit unsigned integer from md5 of ``seed:key`` (as bigint)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), k.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def uniform(key: Column | str, seed: int | str) -> Column:
    """Uniform number in [0, 1) from the row key and a seed."""
    return hash_int(key, seed) / F.lit(TWO_32)


def sql_hash_int(key_sql: str, seed: int | str) -> str:
    """The same 32-bit hash in DuckDB SQL (used by oracles)."""
    return f"('0x' || substr(md5('{seed}:' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT"


def sql_uniform(key_sql: str, seed: int | str) -> str:
    return f"({sql_hash_int(key_sql, seed)} / 4294967296.0)"


def row_fingerprint(cols: list[str]) -> Column:
    """Fast 64-bit hash of a whole row (order of rows does not matter downstream)."""
    return F.xxhash64(*[F.col(c) for c in cols])
