"""Benchmark: headline reports on the test tables.

Runs each query of ``HEADLINE`` end to end (fixture build, prepare, report,
collect) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints one JSON
line: {"metric", "value" (total seconds), "unit", "queries": {name: sec}, "sf"}.
The plot-free stages of the published baseline are statistics, plausibility,
extremes, VIF and similarity; the rest of the list covers the other report
families.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "distribution_stats_f1",
    "plausibility_f1",
    "extremes_f1",
    "similarity_stats_f1",
    "comparison_report_f1",
    "univariate_outliers_f1",
    "redundancy_report_f7",
    "pearson_matrix_f7",
    "paired_report_f5",
    "record_matching_f5",
    "quality_score_f1",
    "missingness_f2",
    "overview_f2",
]


def main():
    """Reports on the same fixture share one prepared pair and its ``Tables``
    (as ``pipeline.run`` does); each report's time includes whatever shared
    table it is the first to need."""
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from featurelens.plans.tables import Tables
    from featurelens.registry import OPS, rounded
    from featurelens.session import local_session
    from featurelens.sources.fixtures import FIXTURES
    from featurelens.sources.loader import prepare

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2))
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    times = {}
    by_fx = {}
    for name in HEADLINE:
        by_fx.setdefault(OPS[name][0], []).append(name)
    for fx, names in by_fx.items():
        t0 = time.time()
        d1, d2, spec = FIXTURES[fx](spark, sf_dir)
        p = prepare(d1, d2, spec)
        t = Tables(p)
        setup = time.time() - t0
        for i, name in enumerate(names):
            _, op, on_prepared = OPS[name]
            t0 = time.time()
            rounded(op(p) if on_prepared else op(t)).collect()
            times[name] = round(time.time() - t0 + (setup if i == 0 else 0.0), 3)
        t.release()
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_reports_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
