"""Checked queries: feature recipes over lineitem (F-1 … F-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..session import checkpoint
from ..sources.tables import view, with_views
from . import register, rounded, sql_round

TGT = "l_extendedprice"
SRC = ["l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber"]
OPS = ["add", "subtract", "multiply", "divide", "mean", "absolute_difference", "square"]


def _sql_expr(op, a, b=None):
    return {"add": f"{a} + {b}", "subtract": f"{a} - {b}", "multiply": f"{a} * {b}",
            "divide": f"CASE WHEN abs({b}) > 1e-12 THEN {a} / {b} END", "mean": f"({a} + {b}) / 2.0",
            "absolute_difference": f"abs({a} - {b})", "square": f"{a} * {a}"}[op]


@register("recipe_ops", with_views(sql_round(
    "SELECT _rid, " + ", ".join(f"{_sql_expr(op, 'l_quantity', 'l_discount')} AS r_{op}" for op in OPS) + " FROM li",
    [f"r_{op}" for op in OPS]), "li"))
def recipe_ops(spark, sf):
    d = view(spark, sf, "li")
    return rounded(d.select("_rid", *[FE.recipe_expr(op, ["l_quantity", "l_discount"] if op != "square" else ["l_quantity"])
                                      .alias(f"r_{op}") for op in OPS]))


def _user_recipes(spark):
    rows = [("qty x disc", "product", ["l_quantity", "l_discount"], "", "user"),
            ("", "Ratio", ["l_extendedprice", "l_quantity"], "", "user"),
            ("qty_x_disc", "multiply", ["l_quantity", "l_discount"], "", "user"),
            ("bad", "cube", ["l_quantity"], "", "user"),
            ("two", "square", ["l_quantity", "l_tax"], "", "user"),
            ("ghost", "add", ["l_quantity", "no_such_col"], "", "user"),
            ("disc_x_qty", "x", ["l_discount", "l_quantity"], "", "user"),
            ("tax sq", "squared", ["l_tax"], "", "user")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "_pos long, name string, operation string, columns array<string>, reason string, source string")


_VALID = [("fe_qty_x_disc", "multiply", "accepted", None, "l_quantity * l_discount"),
          ("fe_l_extendedprice_l_quantity_divide", "divide", "accepted", None,
           "CASE WHEN abs(l_quantity) > 1e-12 THEN l_extendedprice / l_quantity END"),
          ("fe_qty_x_disc_2", "multiply", "accepted", None, "l_quantity * l_discount"),
          ("fe_bad", "cube", "rejected", "operation is not known: cube", None),
          ("fe_two", "square", "rejected", "wrong number of columns, expected 1", None),
          ("fe_ghost", "add", "rejected", "columns not in the table: no_such_col", None),
          ("fe_disc_x_qty", "multiply", "accepted", None, "l_discount * l_quantity"),
          ("fe_tax_sq", "square", "accepted", None, "l_tax * l_tax")]


@register("recipe_validate", with_views(" UNION ALL ".join(
    f"SELECT '{n}' AS name, '{op}' AS operation, '{st}' AS status, {repr(err) if err else 'NULL'} AS error, "
    f"{'count(' + e + ')' if e else 'count(NULL)'}::BIGINT AS n_values FROM li" for n, op, st, err, e in _VALID), "li"))
def recipe_validate(spark, sf):
    d = view(spark, sf, "li")
    norm = FE.normalize_recipes(_user_recipes(spark), d.columns)
    rows = norm.collect()
    exprs = [F.count(FE.recipe_expr(r["operation"], list(r["columns"]))).alias(r["name"]) if r["status"] == "accepted"
             else F.lit(0).alias(r["name"]) for r in rows]
    counts = d.agg(*exprs).unpivot([], [r["name"] for r in rows], "name", "n_values")
    return norm.select("name", "operation", "status", "error").join(counts, "name") \
        .withColumn("n_values", F.col("n_values").cast("long"))


@register("recipe_dedupe", with_views("""
SELECT name, signature, count(*) FILTER (WHERE l_quantity * l_discount IS NOT NULL)::BIGINT AS n_values
FROM (VALUES ('fe_qty_x_disc', 'multiply:l_discount,l_quantity'),
             ('fe_l_extendedprice_l_quantity_divide', 'divide:l_extendedprice,l_quantity'),
             ('fe_tax_sq', 'square:l_tax')) AS t(name, signature), li GROUP BY 1, 2""", "li"))
def recipe_dedupe(spark, sf):
    d = view(spark, sf, "li")
    norm = FE.normalize_recipes(_user_recipes(spark), d.columns).where("status = 'accepted'")
    dd = FE.dedupe_recipes(norm).select("name", "signature")
    n = d.select(F.count(F.col("l_quantity") * F.col("l_discount")).cast("long")).scalar()
    return dd.select("name", "signature", n.alias("n_values"))


def _gen_sql(max_candidates=30):
    corr = " UNION ALL ".join(f"SELECT '{x}' AS col, coalesce(corr({x}, {TGT}), 0) AS r FROM li" for x in SRC)
    ops = " UNION ALL ".join(f"SELECT {i} AS oi, '{op}' AS op" for i, op in enumerate(FE.GENERATOR_OPS))
    return with_views(f"""
WITH c AS ({corr}),
rk AS (SELECT col, row_number() OVER (ORDER BY abs(r) DESC, col) AS k FROM c),
top AS (SELECT * FROM rk WHERE k <= 6),
pairs AS (SELECT 'fe_' || a.col || '_' || o.op || '_' || b.col AS name, o.op AS operation,
                 a.k * 100 + b.k AS pk, o.oi FROM top a JOIN top b ON a.k < b.k, ({ops}) o),
sq AS (SELECT 'fe_' || col || '_square' AS name, 'square' AS operation, 10000 + k AS pk, 0 AS oi FROM top),
allr AS (SELECT * FROM pairs UNION ALL SELECT * FROM sq)
SELECT name, operation FROM allr ORDER BY pk, oi LIMIT {max_candidates}""", "li")


@register("recipe_generate", _gen_sql())
def recipe_generate(spark, sf):
    return FE.generate_recipes(view(spark, sf, "li"), TGT, SRC, 6, 30).select("name", "operation")


@register("candidate_corr", with_views(sql_round(" UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", coalesce(corr({x}, {TGT}), 0) AS corr FROM li" for x in SRC), ["corr"]), "li"))
def candidate_corr(spark, sf):
    return rounded(FE.candidate_corr(view(spark, sf, "li"), TGT, SRC))


def _materialize_rows(spark, sf):
    d = view(spark, sf, "li")
    gen = FE.generate_recipes(d, TGT, SRC, 6, 30)
    norm = FE.normalize_recipes(gen, d.columns)
    return d, norm, FE.materialize(d, norm, TGT)


def _materialized_sql() -> str:
    """Every ordered pair's candidates, of which the generated ones count."""
    gen = _gen_sql().removeprefix("WITH ")
    one = []
    pairs = [(op, a, b) for op in FE.GENERATOR_OPS for a in SRC for b in SRC if a != b] + [("square", a, None) for a in SRC]
    for op, a, b in pairs:
        e = _sql_expr(op, f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)" if b else None)
        name = f"fe_{a}_{op}_{b}" if b else f"fe_{a}_square"
        one.append(f"SELECT '{name}' AS name, coalesce(corr(x, y), 0.0) AS corr, count(DISTINCT x) AS d, "
                   f"stddev_pop(x) AS s, max(abs(x)) AS m FROM (SELECT coalesce({e}, (SELECT coalesce(quantile_cont({e}, 0.5), 0) FROM li)) "
                   f"AS x, {TGT} AS y FROM li)")
    const = "(d < 2 OR coalesce(s, 0) <= 1e-12 * greatest(1.0, m))"
    inner = (f"SELECT name, corr, NOT {const} AS keep, CASE WHEN {const} THEN 'constant or near-constant' ELSE 'ok' END AS reason "
             f"FROM (SELECT name FROM g) JOIN st USING (name)")
    head, tail = gen.split("SELECT name, operation FROM allr", 1)
    return f"WITH {head.rstrip()},\ng AS (SELECT name, operation FROM allr{tail}),\nst AS ({' UNION ALL '.join(one)}),\nres AS ({inner})\n"


@register("recipe_materialize", _materialized_sql() + sql_round("SELECT * FROM res", ["corr"]))
def recipe_materialize(spark, sf):
    _, _, st = _materialize_rows(spark, sf)
    return rounded(st)


@register("feature_select_topk", _materialized_sql() + sql_round("""
SELECT *, coalesce(rank <= 5, false) AS selected FROM (
  SELECT *, CASE WHEN keep THEN CAST(row_number() OVER (PARTITION BY keep ORDER BY abs(corr) DESC, name) AS INTEGER) END AS rank FROM res)""", ["corr"]))
def feature_select_topk(spark, sf):
    _, _, st = _materialize_rows(spark, sf)
    return rounded(FE.select_topk(st, 5))


@register("recipe_supplement")
def recipe_supplement(spark, sf):
    d = checkpoint(view(spark, sf, "li"))       # the steps read it a dozen times
    gen = FE.generate_recipes(d, TGT, SRC, 6, 30)
    sup = FE.supplement_recipes(_user_recipes(spark), gen, d.columns, 12)
    st = FE.materialize(d, sup, TGT)
    out = FE.append_features(d, sup, FE.select_topk(st, 5))
    return out.drop("l_shipdate")

