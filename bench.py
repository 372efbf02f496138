"""Headline-query benchmark.

Runs the registered headline queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "...", "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Every query is executed in full through the ``noop`` sink (all columns computed, no
collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "numeric_profile", "missing_profile", "distinct_profile", "top_values", "low_variance",
    "duplicate_rows", "corr_matrix", "anova_f", "cramers_v", "split_stratified", "impute_median",
    "clip_iqr", "scale_standard", "frequency_encode", "label_encode", "metric_f1", "auc",
    "recipe_materialize", "preprocess_dynamic",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    os.environ.setdefault("BENCH_CPUS", "8")
    from tablesmith import catalog
    from tablesmith.session import get_session
    spark = get_session()
    catalog.load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in catalog.QUERIES]
    # warm-up on the smallest tables: JVM start, JIT and first code generation are not
    # part of any query's time
    for w in ("missing_profile", "numeric_profile", "split_stratified"):
        catalog.QUERIES[w](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
