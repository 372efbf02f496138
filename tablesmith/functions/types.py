"""Column type classes, safe casts and missing-value normalisation (PF-1, PF-2, PF-6,
PF-7, PF-12, E-9, IO-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that decide what a string "looks like".
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INT_PATTERN = r"^\s*[+-]?\d+\s*$"
DATE_PATTERN = r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd",
                "MM/dd/yyyy", "dd-MM-yyyy", "d MMM yyyy", "MMM d, yyyy"]


def q(name: str) -> str:
    """Back-tick quote a column name (dots, spaces, hyphens are legal here)."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def type_class(dt: T.DataType) -> str:
    """boolean / numeric / datetime / categorical, in that order of checks."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.NumericType):
        return "numeric"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "categorical"


def columns_of(df: DataFrame, kind: str | tuple[str, ...], exclude: list[str] | None = None) -> list[str]:
    kinds = (kind,) if isinstance(kind, str) else kind
    skip = set(exclude or [])
    return [f.name for f in df.schema.fields
            if type_class(f.dataType) in kinds and f.name not in skip and not f.name.startswith("_")]


def feature_columns(df: DataFrame, target: str | None = None) -> list[str]:
    """All user columns except the target and the library's own (``_rid``, ``_split``)."""
    return [f.name for f in df.schema.fields if f.name != target and not f.name.startswith("_")]


def safe_numeric(col: Column, dt: T.DataType | None = None) -> Column:
    """Parse to double; unparseable, NaN and ±Infinity become NULL (PF-6)."""
    if dt is not None and isinstance(dt, T.NumericType):
        x = col.cast("double")
    else:
        s = col.cast("string")
        x = F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double"))
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def nan_to_null(col: Column) -> Column:
    """NaN and ±Infinity → NULL on a floating column (PF-12)."""
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(None)).otherwise(col)


def sanitize_floats(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([nan_to_null(c(n)).alias(n) if n in floats else c(n) for n in df.columns])


def apply_na_tokens(df: DataFrame, tokens: list[str] = ("?",), recast: bool = True) -> DataFrame:
    """Treat NA tokens in string columns as missing, then re-type columns that are now
    fully numeric (IO-4).  One aggregate decides the re-cast, no driver loop over rows."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    toks = list(tokens)
    out = df.select([F.when(F.trim(c(n)).isin(toks), F.lit(None).cast("string")).otherwise(c(n)).alias(n)
                     if n in strings else c(n) for n in df.columns])
    if not recast or not strings:
        return out
    checks = out.agg(*[F.min(F.when(c(n).isNull(), True).otherwise(c(n).rlike(NUMERIC_PATTERN))).alias(n)
                       for n in strings]).first()
    numeric_now = {n for n in strings if checks[n]}
    return out.select([safe_numeric(c(n)).alias(n) if n in numeric_now else c(n) for n in out.columns])


def parse_datetime(col: Column) -> Column:
    """First format that parses wins; NULL if none does.  Every format holds two separators, so a text without them
    is not tried: each failed try costs an exception."""
    s = F.trim(col.cast("string"))
    return F.when(s.rlike(r"(?s)[-/ ].*[-/ ]"), F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in DATE_FORMATS]))


def parse_class(col: Column) -> Column:
    """Classify one string value as int / float / date / text (P-14)."""
    s = col.cast("string")
    return (F.when(s.isNull(), F.lit(None))
            .when(s.rlike(INT_PATTERN), F.lit("int"))
            .when(s.rlike(NUMERIC_PATTERN), F.lit("float"))
            .when(s.rlike(r"^\s*\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"), F.lit("date"))
            .otherwise(F.lit("text")))


def qcols(names) -> list[Column]:
    """Quoted column references (for ``unpivot`` and friends: dots, spaces, hyphens)."""
    return [c(n) for n in names]
