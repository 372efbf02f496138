"""Per-column quantiles in long form: (column, p, value), linear interpolation between
neighbouring ranks (equal to pandas and DuckDB ``quantile_cont``).

* ``exact``   two scans and no buffer of a column's values: approximate quantiles a little
              below and above each probability bracket the values that can hold its ranks;
              the second scan keeps the values inside the brackets, counts everything between
              two brackets as one row, and finds the ranks in that small table.
              Brackets that would still hold more than ``RANKED`` rows are narrowed by further
              scans first, a few thousand times each.
* ``approx``  ``percentile_approx`` (bounded sketch, one pass).

More than ``MAX_BRACKETS`` quantiles of a column are read off the running counts of its distinct
values (``even_quantiles``), which range partitions add up (``common.prefix_sums``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import c, qcols
from .common import few_or_written, prefix_sums


def long_values(df: DataFrame, cols: list[str], value_type: str = "double") -> DataFrame:
    """Unpivot ``cols`` to (column, value) rows, dropping NULLs (Expand, no shuffle)."""
    if not cols:
        return df.sparkSession.createDataFrame([], f"column string, value {value_type}")
    wide = df.select([c(n).cast(value_type).alias(n) for n in cols])
    out = wide.unpivot([], qcols(cols), "column", "value") if len(cols) > 0 else wide
    return out.where(F.col("value").isNotNull() & ~F.isnan("value") if value_type == "double"
                     else F.col("value").isNotNull())


MAX_BRACKETS = 16
COLUMNS_A_PASS = 64
RANKED = 100_000        # rows that may be ranked in one task


def quantile_table(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact",
                   accuracy: int = 10000) -> DataFrame:
    """(column string, p double, value double) for every column and probability."""
    probs = [float(p) for p in probs]
    if method in ("exact", "distributed") and len(probs) <= MAX_BRACKETS and cols:
        return _bracketed_columns(df, cols, sorted(set(probs)), accuracy)
    return quantiles_of_long(long_values(df, cols), probs, method, accuracy)


def _bracketed_columns(df: DataFrame, cols: list[str], at: list[float], accuracy: int) -> DataFrame:
    """The brackets of ``_bracketed`` for columns side by side: they are literals of one projection, so the
    second scan compares plain columns and nothing is joined."""
    eps = 2.0 / accuracy
    x = [c(n).cast("double") for n in cols]
    d = df.select([F.when(~F.isnan(v), v).alias(f"x{i}") for i, v in enumerate(x)])
    edges = F.array(*[F.lit(e) for p in at for e in (max(0.0, p - eps), min(1.0, p + eps))])
    kept = []
    for start in range(0, len(cols), COLUMNS_A_PASS):
        part = range(start, min(len(cols), start + COLUMNS_A_PASS))
        # one row, with two numbers a bracket
        got = d.agg(*[e for i in part for e in (F.count(f"x{i}").alias(f"n{i}"),
                                                F.percentile_approx(f"x{i}", edges, accuracy).alias(f"e{i}"))]).first()
        sized = {i: (got[f"n{i}"], got[f"e{i}"]) for i in part if got[f"n{i}"] >= 10 * accuracy}
        edges_of = _narrowed(d, sized, at, eps, accuracy)
        kept += [_kept(F.col(f"x{i}"), at, eps, edges_of.get(i)).alias(cols[i]) for i in part]
    seen = d.select(kept).unpivot([], qcols(cols), "column", "value").where(F.col("value").isNotNull()) \
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    return _pick_ranks(seen.withColumn("_gap", F.lit(0)), at, "column")


def _narrowed(d: DataFrame, sized: dict, at: list[float], eps: float, accuracy: int) -> dict:
    """The edges (low, high, low, high, …) by column of brackets that hold about ``RANKED`` rows at most.  A bracket
    of more rows is replaced by one around its quantile's rank among the rows inside, in scans of all such at once."""
    edges = {i: list(e) for i, (_, e) in sized.items()}
    held = {(i, k): 2 * (eps + 1.0 / accuracy) * n for i, (n, _) in sized.items() for k in range(len(at))}
    while todo := [x for x, n in held.items() if n > RANKED and edges[x[0]][2 * x[1]] < edges[x[0]][2 * x[1] + 1]
                   and 0.0 < at[x[1]] < 1.0]:
        todo = todo[:COLUMNS_A_PASS]
        low, high = ({x: edges[x[0]][2 * x[1] + s] for x in todo} for s in (0, 1))
        aggs = []
        for i, k in todo:
            v = F.col(f"x{i}")
            aggs += [F.count_if(v < low[i, k]).alias(f"b{i}_{k}"),
                     F.count_if((v >= low[i, k]) & (v <= high[i, k])).alias(f"i{i}_{k}")]
        counts = d.agg(*aggs).first()       # one row, two numbers a bracket
        aggs = []
        for i, k in todo:
            inside = max(counts[f"i{i}_{k}"], 1)
            p = (at[k] * (sized[i][0] - 1) - counts[f"b{i}_{k}"]) / inside
            around = [min(1.0, max(0.0, p + s * eps)) for s in (-1, 1)]
            v = F.col(f"x{i}")
            within = F.when((v >= low[i, k]) & (v <= high[i, k]), v)
            aggs.append(F.percentile_approx(within, F.array(*[F.lit(x) for x in around]), accuracy).alias(f"e{i}_{k}"))
            held[i, k] = 2 * (eps + 1.0 / accuracy) * inside if inside >= 10 * accuracy else 0
        new = d.agg(*aggs).first()
        for i, k in todo:
            if held[i, k]:
                edges[i][2 * k:2 * k + 2] = new[f"e{i}_{k}"]
    return {i: _apart(e) for i, e in edges.items()}


def _apart(edges: list) -> list:
    """Brackets in order, those that overlap joined to one."""
    out = list(edges)
    for k in range(2, len(out), 2):
        if out[k] <= out[k - 1]:
            out[k] = out[k - 2]
            out[k + 1] = max(out[k + 1], out[k - 1])
    return out


def value_at_rank(df: DataFrame, col: str, rank: int, accuracy: int = 10_000):
    """The value of a number column at ``rank`` (0 is the smallest) in order, None beyond the last: the range that can
    hold it is narrowed by an approximate quantile and exact counts until ``RANKED`` rows are left to be ordered."""
    v, low, high = F.col(f"`{col}`"), None, None
    d = df.where(v.isNotNull()).select(v)
    left, n = rank, d.count()
    if rank < 0 or rank >= n:
        return None
    while n > RANKED:
        p = left / (n - 1)
        at = [max(0.0, p - 2.0 / accuracy), min(1.0, p + 2.0 / accuracy)]
        a, b = d.agg(F.percentile_approx(v, at, accuracy)).first()[0]
        below, inside = d.agg(F.count_if(v < a), F.count_if((v >= a) & (v <= b))).first()
        if not below <= left < below + inside:
            raise RuntimeError("an approximate quantile missed its error bound")
        if a == b:
            return a
        low, high = a, b
        d, left, n = d.where(v.between(low, high)), left - below, inside
    return d.orderBy(v).limit(left + 1).agg(F.max(v)).first()[0]


def even_quantiles(lv: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(column, j, value): of each column of (column, value) the ``sizes[column]`` quantiles at j / (size - 1).  The
    distinct values are counted and range partitioned; each lists the ranks that its own and its predecessors'
    counts hold."""
    if not sizes:
        return lv.sparkSession.createDataFrame([], "column string, j long, value double")
    seen = lv.where(F.col("column").isin(list(sizes))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    seen = prefix_sums(seen, ["column"], "value", {"before": F.col("n")})
    steps = F.create_map(*[F.lit(x) for c_, m in sizes.items() for x in (c_, m - 1)])
    total = lv.groupBy("column").agg(F.count(F.lit(1)).alias("all"))
    d = seen.join(F.broadcast(total), "column").withColumn("m", steps[F.col("column")].cast("long"))       # a row a column
    # quantile j lies at rank j (all - 1) / m, between two ranks: a value holds those from before to before + n - 1
    span = F.greatest(F.col("all") - 1, F.lit(1))
    first = F.greatest(F.lit(0), F.ceil((F.col("before") - 1) * F.col("m") / span).cast("long") - 1)
    last = F.least(F.col("m"), F.floor((F.col("before") + F.col("n")) * F.col("m") / span).cast("long") + 1)
    hit = d.where(first <= last).select("column", "value", "before", "n", "all", "m", F.explode(F.sequence(first, last)).alias("j"))
    low = F.expr("(j * (all - 1)) div m")
    rest = F.col("j") * (F.col("all") - 1) - low * F.col("m")
    high = low + F.when(rest > 0, 1).otherwise(0)

    def mine(r):
        return (r >= F.col("before")) & (r < F.col("before") + F.col("n"))

    hit = hit.where(mine(low) | mine(high)).withColumn("step", rest / F.col("m"))
    return hit.groupBy("column", "j").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.max("step").alias("s")) \
        .select("column", "j", (F.col("lo") + F.col("s") * (F.col("hi") - F.col("lo"))).alias("value"))


def _kept(v, at: list[float], eps: float, edges: list | None):
    """A value inside a bracket as it is; of a gap between two brackets one number stands for all its values, as
    no rank that is asked for lies there.  Without ``edges`` all values are kept."""
    if edges is None:
        return v
    low = [float("-inf") if p - eps <= 0 else edges[2 * k] for k, p in enumerate(at)]
    high = [float("inf") if p + eps >= 1 else edges[2 * k + 1] for k, p in enumerate(at)]
    out = F.when(v.isNull(), v)
    for k, (lo, hi) in enumerate(zip(low, high, strict=True)):
        before = max(high[:k], default=float("-inf"))
        if lo > before:
            out = out.when(v < F.lit(lo), F.lit(before + (lo - before) / 2 if k else float("-inf")))
        out = out.when(v <= F.lit(hi), v)
    return out.otherwise(F.lit(float("inf")))


def _pick_ranks(seen: DataFrame, at: list[float], key: str) -> DataFrame:
    """Quantiles from (key, value, _gap, _n): values with their counts, and counts of what stands between them."""
    w = Window.partitionBy(key).orderBy("value", "_gap")
    total = F.sum("_n").over(Window.partitionBy(key))
    seen = seen.withColumn("_all", total).withColumn("_end", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = (F.col("_all") - 1).cast("double")
    targets = F.array(*[F.struct(F.lit(p).alias("p"), (rank * p).alias("h"), f(rank * p).cast("long").alias("r"))
                        for p in at for f in (F.floor, F.ceil)])
    hit = seen.where("_gap = 0").select(key, "value", F.explode(F.filter(
        targets, lambda x: (x["r"] >= F.col("_end") - F.col("_n")) & (x["r"] < F.col("_end")))).alias("x"))
    step = F.col("x.h") - F.floor("x.h")
    return hit.groupBy(key, F.col("x.p").alias("p")).agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.max(step).alias("_f")) \
        .select(key, "p", (F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))).alias("value"))


def quantiles_of_long(lv: DataFrame, probs: list[float], method: str = "exact",
                      accuracy: int = 10000, key: str = "column", few_keys: bool = True) -> DataFrame:
    """``few_keys``: the keys are columns, so a row for each may be broadcast."""
    probs = [float(p) for p in probs]
    if method in ("exact", "distributed") and len(probs) <= MAX_BRACKETS:
        return _bracketed(lv, probs, key, accuracy, few_keys)
    if method != "approx":
        raise ValueError(f"{len(probs)} quantiles by {method}: use even_quantiles")
    got = lv.groupBy(key).agg(F.percentile_approx("value", F.array(*[F.lit(p) for p in probs]), accuracy).alias("qs"))
    return (got.select(key, F.posexplode("qs").alias("i", "value"))
            .join(F.broadcast(lv.sparkSession.createDataFrame([(i, p) for i, p in enumerate(probs)],
                                                              "i int, p double")), "i")
            .select(key, "p", F.col("value").cast("double").alias("value")))


def _bracketed(lv: DataFrame, probs: list[float], key: str, accuracy: int, few_keys: bool) -> DataFrame:
    # percentile_approx errs by at most n / accuracy ranks; a bracket spans twice that on both sides, which is
    # ten ranks to spare from n = 10 * accuracy on; the values of smaller keys are all kept
    eps = 2.0 / accuracy
    at = sorted(set(probs))
    edges = F.percentile_approx("value", F.array(*[F.lit(x) for p in at for x in (max(0.0, p - eps), min(1.0, p + eps))]), accuracy)
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    brackets = F.array(*[F.struct((low if p - eps <= 0 else F.col("_e")[2 * i]).alias("lo"),
                                  (high if p + eps >= 1 else F.col("_e")[2 * i + 1]).alias("hi")) for i, p in enumerate(at)])
    brackets = F.when(F.col("_m") < 10 * accuracy, F.array(F.struct(low.alias("lo"), high.alias("hi")))).otherwise(brackets)
    b = lv.groupBy(key).agg(edges.alias("_e"), F.count(F.lit(1)).alias("_m")).select(F.col(key).alias("_k"), brackets.alias("_b"))
    v = F.col("value")
    # the values stay where they are unless there are very many keys
    d = lv.select(key, "value").join(F.broadcast(b) if few_keys else few_or_written(b), F.col(key) == F.col("_k"))
    inside = F.exists("_b", lambda x: (v >= x["lo"]) & (v <= x["hi"]))
    # a value between brackets only counts: it stands, as a gap, right after the last bracket below it
    below = F.aggregate("_b", low, lambda a, x: F.when(x["hi"] < v, F.greatest(a, x["hi"])).otherwise(a))
    seen = d.select(key, (~inside).cast("int").alias("_gap"), F.when(inside, v).otherwise(below).alias("value")) \
        .groupBy(key, "value", "_gap").agg(F.count(F.lit(1)).alias("_n"))
    return _pick_ranks(seen, at, key)
