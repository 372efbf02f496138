"""Helpers shared by fitted operators.

Fitted parameters are small DataFrames.  Two ways to apply them:

* per-column scalars (one row per column: fill values, bounds, means) are read once on
  the driver — bounded by the number of columns — and inlined as literals, so the apply
  step is a single projection inside whole-stage codegen;
* per-value maps (category codes, frequencies) are joined; the map is broadcast only
  after its bytes are checked against ``MAX_BROADCAST_BYTES``, else a shuffle join runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import c

MAX_BROADCAST_BYTES = 64 << 20
MAX_PARAM_ROWS = 100_000


def param_rows(params: DataFrame, limit: int = MAX_PARAM_ROWS) -> list:
    """Read a parameter table (one row per column or per (column, category)).  Refuses
    anything larger than ``limit`` rows: parameters never carry data rows."""
    rows = params.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"parameter table has more than {limit} rows; join it instead")
    return rows


def row_bytes(df: DataFrame) -> Column:
    """An estimate of a row's size in memory: the lengths of its texts and 16 bytes for each column."""
    long = [F.coalesce(F.octet_length(c(f.name)), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    total = F.lit(16 * (1 + len(df.columns)))
    for x in long:
        total = total + x
    return total.cast("long")


def maybe_broadcast(small: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when the rows' bytes are proven few; otherwise the join is left to Spark, and adaptive
    execution splits the rows of a hot value.  Give a written table, which is read twice."""
    size = small.agg(F.sum(row_bytes(small))).first()[0] or 0
    return F.broadcast(small) if size <= max_bytes else small


def materialize_small(df: DataFrame, limit: int = MAX_PARAM_ROWS) -> DataFrame:
    """Compute a small result (evidence, plan, parameters: one row per column) once and
    keep it as a local relation, so later steps do not recompute its lineage."""
    rows = param_rows(df, limit)
    return df.sparkSession.createDataFrame(rows, df.schema)


def few_or_written(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A small result computed once: up to ``most`` rows as a local table to broadcast, more as a written one."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        from ..session import checkpoint
        return checkpoint(df)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on group columns where NULL is a group of its own; the keys come from the left."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`"))
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def prefix_sums(df: DataFrame, group: list[str], order: str, weights: dict[str, Column]) -> DataFrame:
    """Add, for each name in ``weights``, the sum of that weight over the rows of the group
    before this one in ``order`` (distinct within a group).

    Rows are range-partitioned by (group, order) and written once, so the ranges are fixed;
    a range sums its own rows, and the ranges before it come from a table of one row per
    range and group.  No group is ever ordered in one task."""
    from ..session import checkpoint

    keys = [*group, order]
    d = df.withColumns({f"__w_{n}": w for n, w in weights.items()})
    d = checkpoint(d.repartitionByRange(*[F.col(f"`{k}`") for k in keys]).withColumn("__part", F.spark_partition_id()))
    sums = d.groupBy("__part", *group).agg(*[F.sum(f"__w_{n}").alias(f"__s_{n}") for n in weights])
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", *group, *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in weights])
    within = Window.partitionBy("__part", *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = join_groups(d, sums, ["__part", *group])
    return out.select(*[F.col(f"`{x}`") for x in df.columns],
                      *[(F.col(f"__b_{n}") + F.coalesce(F.sum(f"__w_{n}").over(within), F.lit(0))).alias(n) for n in weights])


def column_stats(df: DataFrame, cols: list[str], stats: dict) -> DataFrame:
    """(column, one column per statistic) of the numeric ``cols`` (NaN is missing); columns without a value
    are left out.  ``stats`` maps names to functions of a column expression.  The columns are stacked before
    the aggregate: an aggregate of many columns side by side is too wide for generated code."""
    x = df.select([c(n).cast("double").alias(n) for n in cols])
    lv = x.unpivot([], [F.col("`" + n.replace("`", "``") + "`") for n in cols], "column", "value")
    return lv.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("column") \
        .agg(*[f(F.col("value")).alias(s) for s, f in stats.items()])
