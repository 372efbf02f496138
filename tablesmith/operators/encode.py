"""Encoding, datetime parts and type conversion (E-1 … E-10).

Category lists are fitted on train rows.  One-hot categories are bounded by the plan
(≤ 15 by default, ``max_categories`` enforced) and inlined as literals.  Label and
frequency maps are (column, value, code) DataFrames applied by a join whose broadcast
is size-checked.  Label codes are prefix counts over the range-partitioned distinct values,
so no column's values are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import c, parse_datetime, safe_numeric, qcols
from ..session import checkpoint
from .common import MAX_BROADCAST_BYTES, param_rows, prefix_sums, row_bytes
from .impute import _train

MAX_ONEHOT_CATEGORIES = 1000


def _distinct_long(df: DataFrame, cols: list[str], keep_null: bool = False) -> DataFrame:
    lv = df.select([c(n).cast("string").alias(n) for n in cols]).unpivot([], qcols(cols), "column", "value")
    if not keep_null:
        lv = lv.where(F.col("value").isNotNull())
    return lv


# ------------------------------------------------------------------ E-1, E-1b

def fit_onehot(df: DataFrame, cols: list[str], max_categories: int = MAX_ONEHOT_CATEGORIES) -> DataFrame:
    """(column, category, slot): sorted distinct train values per column."""
    d = _distinct_long(_train(df), cols).distinct()
    wide = [r["column"] for r in d.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_categories).collect()]
    if wide:
        raise ValueError(f"more than {max_categories} categories in {sorted(wide)}: use a label, frequency or hash "
                         "encoding, or the sparse stages of ml_onehot_stages")
    w = Window.partitionBy("column").orderBy("value")        # at most max_categories rows each
    return d.select("column", F.col("value").alias("category"), (F.row_number().over(w) - 1).cast("int").alias("slot"))


def apply_onehot(df: DataFrame, params: DataFrame, sep: str = "__", drop_first: bool = False,
                 keep_original: bool = False) -> DataFrame:
    """``{col}{sep}{cat}`` int columns; unseen and missing → all zeros."""
    cats: dict[str, list[str]] = {}
    for r in sorted(param_rows(params), key=lambda r: (r["column"], r["slot"])):
        cats.setdefault(r["column"], []).append(r["category"])
    sel = []
    for n in df.columns:
        if n not in cats:
            sel.append(c(n))
            continue
        if keep_original:
            sel.append(c(n))
        vals = cats[n][1:] if drop_first else cats[n]
        s = c(n).cast("string")
        sel.extend(F.coalesce((s == F.lit(v)).cast("int"), F.lit(0)).alias(f"{n}{sep}{v}") for v in vals)
    return df.select(sel)


def dummies(df: DataFrame, cols: list[str], drop_first: bool = False) -> DataFrame:
    """Whole-table dummy columns ``{col}_{cat}`` (E-1b)."""
    return apply_onehot(df, fit_onehot(df.drop("_split") if "_split" in df.columns else df, cols),
                        sep="_", drop_first=drop_first)


def ml_onehot_stages(cols: list[str]):
    """MLlib stages that ignore unseen categories (E-1c): the extra 'unseen' index of
    ``StringIndexer(keep)`` is the slot ``dropLast`` removes, so unseen → zeros."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = [f"{x}__idx" for x in cols]
    return [StringIndexer(inputCols=cols, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=idx, outputCols=[f"{x}__ohe" for x in cols], handleInvalid="error",
                          dropLast=True)]


# ------------------------------------------------------------------ E-2, E-6, E-10

def fit_label(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code): code = rank of the value among sorted distinct train values."""
    d = _distinct_long(_train(df), cols).distinct()
    return prefix_sums(d, ["column"], "value", {"code": F.lit(1).cast("long")})


def apply_map(df: DataFrame, params: DataFrame, value_col: str, default, suffix: str = "",
              null_safe: bool = False) -> DataFrame:
    """Replace each mapped column by its looked-up value.  The map (column, value, ``value_col``) is written once and
    its bytes are added up by column in one job; small parts are broadcast, so all look-ups are one pass over the
    rows, and larger ones are joined by a shuffle in which adaptive execution splits hot values."""
    held = checkpoint(params.select("column", F.col("value").alias("__k"), F.col(value_col).alias("__v")))
    sizes = {r["column"]: r["bytes"] for r in held.groupBy("column").agg(F.sum(row_bytes(held)).alias("bytes")).collect()}
    out = df
    for n, size in sorted(sizes.items()):
        m = held.where(F.col("column") == n).select("__k", "__v")
        key = c(n).cast("string")
        cond = key.eqNullSafe(F.col("__k")) if null_safe else key == F.col("__k")
        out = out.join(F.broadcast(m) if size <= MAX_BROADCAST_BYTES else m, cond, "left")
        out = out.withColumn(n + suffix, F.coalesce(F.col("__v"), F.lit(default))).drop("__k", "__v", *([n] if suffix else []))
    return out


def apply_label(df: DataFrame, params: DataFrame) -> DataFrame:
    """Unseen and missing → −1 (E-2)."""
    return apply_map(df, params, "code", -1)


def target_codes(df: DataFrame, target: str) -> DataFrame:
    """Target to codes when not numeric (E-10): kept numeric when at least half of the
    values parse as numbers, else dense rank of the sorted distinct values."""
    dt = df.schema[target].dataType
    if isinstance(dt, T.NumericType):
        return df
    parsed = safe_numeric(c(target))
    # one number decides the branch (share of values that parse)
    share = df.where(c(target).isNotNull()).select(F.avg(parsed.isNotNull().cast("double"))).first()[0] or 0.0
    if share >= 0.5:
        return df.withColumn(target, parsed)
    codes = fit_label(df.drop("_split") if "_split" in df.columns else df, [target])
    return apply_label(df, codes)


# ------------------------------------------------------------------ E-3

def fit_frequency(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, freq): share of train rows; missing counts as a value."""
    tr = _train(df)
    n = tr.select(F.count(F.lit(1))).scalar()
    d = _distinct_long(tr, cols, keep_null=True)
    return d.groupBy("column", "value").agg((F.count(F.lit(1)) / n).alias("freq"))


def apply_frequency(df: DataFrame, params: DataFrame, suffix: str = "__frequency") -> DataFrame:
    """``{col}__frequency``; unseen → 0.0 (null-safe key)."""
    return apply_map(df, params, "freq", 0.0, suffix=suffix, null_safe=True)


# ------------------------------------------------------------------ E-4, E-5

def hash_encode(df: DataFrame, cols: list[str], n_features: int = 8) -> DataFrame:
    """Signed feature hashing into ``{col}__hash_i``: slot = pmod(h, n), sign from the
    high bit; the same text always lands in the same slot."""
    s = set(cols)
    sel = []
    for n in df.columns:
        if n not in s:
            sel.append(c(n))
            continue
        h = F.conv(F.substring(F.md5(F.coalesce(c(n).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
        slot = F.pmod(h, F.lit(n_features))
        sign = F.when(F.shiftright(h, 59) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        sel.extend(F.when(slot == i, sign).otherwise(F.lit(0.0)).alias(f"{n}__hash_{i}") for i in range(n_features))
    return df.select(sel)


def passthrough_text(df: DataFrame, cols: list[str]) -> DataFrame:
    s = set(cols)
    return df.select([c(n).cast("string").alias(n) if n in s else c(n) for n in df.columns])


# ------------------------------------------------------------------ E-7, E-8, E-9

def datetime_parts(df: DataFrame, cols: list[str], drop: bool = True) -> DataFrame:
    """``{col}__year/__month/__day`` (gaps should be filled first, N-6)."""
    s = set(cols)
    sel = []
    for n in df.columns:
        if n in s:
            if not drop:
                sel.append(c(n))
            sel.extend([F.year(c(n)).alias(f"{n}__year"), F.month(c(n)).alias(f"{n}__month"),
                        F.dayofmonth(c(n)).alias(f"{n}__day")])
        else:
            sel.append(c(n))
    return df.select(sel)


def datetime_epoch(df: DataFrame, cols: list[str]) -> DataFrame:
    """Datetime → integer nanoseconds since the epoch (E-8)."""
    s = set(cols)
    return df.select([(F.unix_micros(c(n).cast("timestamp")) * 1000).alias(n) if n in s else c(n)
                      for n in df.columns])


def convert_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Per-column conversion: numeric (safe parse) / datetime (first format that parses,
    UTC) / text (E-9)."""
    dts = {f.name: f.dataType for f in df.schema.fields}
    sel = []
    for n in df.columns:
        k = kinds.get(n)
        if k == "numeric":
            sel.append(safe_numeric(c(n), dts[n]).alias(n))
        elif k == "datetime":
            sel.append((c(n).cast("timestamp_ntz") if isinstance(dts[n], (T.TimestampType, T.TimestampNTZType, T.DateType))
                        else parse_datetime(c(n)).cast("timestamp_ntz")).alias(n))
        elif k in ("text", "categorical"):
            sel.append(c(n).cast("string").alias(n))
        else:
            sel.append(c(n))
    return df.select(sel)
