"""Registry of checked queries: name → (Spark callable, DuckDB oracle SQL or None).

Every callable takes (spark, sf_dir), reads the provided tables (or views derived from
them) in full, and returns a DataFrame whose columns are aliased exactly like the
oracle's.  Floating outputs are rounded at the very end on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# Final outputs are quantised to 10^-digits with the rounding boundary moved off the
# decimal ties (x.5 at the last digit), which decimal test data hits often; both engines
# then agree even when their sums differ in the last bit.
QUANT_SHIFT = 0.2371


def quantize(col, digits: int = 6):
    """10^-d grid with d = min(digits, max(0, 10 − floor(log10|x|))): about eleven
    significant digits for large values, ``digits`` decimals for small ones."""
    d = F.least(F.lit(digits), F.greatest(F.lit(0), F.lit(10) - F.floor(F.log10(F.abs(col) + F.lit(1e-300)))))
    m = F.pow(F.lit(10.0), d)
    return F.round(col * m - QUANT_SHIFT) / m + F.lit(0.0)   # + 0.0 turns -0.0 into 0.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Quantise every floating column (final step only)."""
    return df.select([quantize(F.col(f"`{f.name}`"), digits).alias(f.name)
                      if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                      for f in df.schema.fields])


def sql_round(inner: str, cols: list[str], digits: int = 6) -> str:
    """DuckDB: round the named double columns of ``inner``."""
    if not cols:
        return inner
    def q(x):
        m = f"pow(10.0, least({digits}, greatest(0, 10 - floor(log10(abs(CAST({x} AS DOUBLE)) + 1e-300)))))"
        return f"round(CAST({x} AS DOUBLE) * {m} - {QUANT_SHIFT}) / {m} + 0.0"
    rep = ", ".join(f"{q(c)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) AS _r"


def sql_union(template: str, cols: list[str]) -> str:
    """UNION ALL of ``template`` formatted with each column name as {c}."""
    return "\nUNION ALL\n".join(template.format(c=c) for c in cols)


def load_all() -> None:
    from . import (profile_q, relate_q, prep_q, plan_q, features_q, metrics_q,  # noqa: F401
                   model_q, misc_q)
