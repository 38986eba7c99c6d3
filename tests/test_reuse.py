"""Reports that others read are finished once; fixtures reach every agreement class and guard."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelens import pipeline
from featurelens.operators import compare, distribution, outliers, paired, profile, quality, redundancy
from featurelens.plans.tables import Tables
from featurelens.sources.fixtures import FIXTURES
from featurelens.sources.loader import prepare
from tests.conftest import SF_SMALL

SHARED = [(profile, "missingness"), (distribution, "plausibility"), (outliers, "univariate_outliers"), (compare, "similarity_stats"),
          (redundancy, "feature_flags"), (paired, "_core"), (quality, "quality_score")]


def counted(monkeypatch):
    calls = Counter()
    for module, name in SHARED:
        def once(*a, _f=getattr(module, name), _n=name, **k):
            calls[_n] += 1
            return _f(*a, **k)
        monkeypatch.setattr(module, name, once)
    return calls


def test_conclusions_build_each_report_once(spark, monkeypatch):
    calls = counted(monkeypatch)
    t = Tables(prepare(*FIXTURES["f4"](spark, SF_SMALL)))
    rows = quality.conclusions(t).collect()
    assert rows and all(calls[n] == 1 for _, n in SHARED)
    assert quality.conclusions(t).count() == len(rows) and all(calls[n] == 1 for _, n in SHARED)


def test_a_run_passes_finished_reports_on(spark, monkeypatch, tmp_path):
    calls = counted(monkeypatch)
    r = pipeline.run(*FIXTURES["f4"](spark, SF_SMALL), heavy=False)
    assert all(calls[n] == 1 for _, n in SHARED)
    assert pipeline.write(r, f"file://{tmp_path}", r.tables.spec) and not r.tables._held
    assert r["feature_quality"].count() == 1  # finished reports outlive the tables


def test_agreement_classes_and_guards(spark):
    t = Tables(prepare(*FIXTURES["f11"](spark, "/root/testdata/sf0.01")))
    got = {r["Feature"]: r for r in paired.paired_stats(t).collect()}
    assert {f: r["Agreement"] for f, r in got.items() if f != "rare"} == {
        "close": "Excellent", "near": "Good", "off": "Moderate", "far": "Fair", "turned": "Poor"}
    few = {r["feature"]: r["count"] for r in t.paired.groupBy("feature").count().collect()}
    assert ("rare" in got) == (few["rare"] >= t.spec.thresholds.min_compare_n)
    assert few["close"] < few["off"]  # pairs with a missing side are left out


def test_running_sums_and_histograms_do_not_count_values_again(spark):
    import re

    from featurelens.plans import rank, shape

    t = Tables(prepare(*FIXTURES["f1"](spark, SF_SMALL)))
    for df in (rank.cumulate(t.ranged, ["feature"], "value", ["n1", "n2"]), shape.histogram(t.vc, 10).where("c1 > 0")):
        plan = df._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation [feature" in plan
        assert not re.search(r"^[ :+-]*Union", plan.split("InMemoryRelation [feature")[0], re.M)
        assert plan.count("InMemoryRelation [feature") == 1


def test_moments_read_the_wide_tables(spark):
    from featurelens.plans import shape

    rows = [(i, 0.1, None, float(i * i), 7.0 if i == 3 else None) for i in range(40)]
    made = spark.createDataFrame(rows, "id int, same double, none double, square double, once double")
    p = prepare(made, made.where("id > 9"), FIXTURES["f1"](spark, SF_SMALL)[2])
    for together in (1, 4):
        got = shape.moments(p, together)
        assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
        r = {(x["ds"], x["feature"]): x for x in got.collect()}
        assert sorted(r) == [(1, "once"), (1, "same"), (1, "square"), (2, "same"), (2, "square")]
        assert r[1, "same"]["var_pop"] == 0 and r[1, "same"]["skew"] is None and r[1, "once"]["var_samp"] is None
        for d, first in ((1, 0), (2, 10)):
            x = np.arange(first, 40.0) ** 2
            e, one = x - x.mean(), r[d, "square"]
            assert [one[k] for k in ("n", "min", "max")] == [len(x), x[0], x[-1]]
            expect = {"mean": x.mean(), "var_pop": x.var(), "var_samp": x.var(ddof=1), "sd_pop": x.std(),
                      "skew": (e ** 3).mean() / x.var() ** 1.5, "kurt": (e ** 4).mean() / x.var() ** 2 - 3}
            assert all(one[k] == pytest.approx(v, rel=1e-12) for k, v in expect.items())


def test_grid_quantiles_read_the_kept_ranks(spark):
    from featurelens.plans import rank

    t = Tables(prepare(*FIXTURES["f1"](spark, SF_SMALL)))
    q = rank.group_quantiles(t.ranged, ["feature"], "value", ["n1", "n2"], [0.1, 0.5], rk=t.rk)
    above = q._jdf.queryExecution().withCachedData().toString().split("InMemoryRelation [feature")[0]
    assert "Union" not in above and "Window" not in above


def test_plausibility_counts_values_not_rows(spark):
    t = Tables(prepare(*FIXTURES["f1"](spark, SF_SMALL)))
    plan = distribution.plausibility(t)._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation [feature") == 1  # the kept value counts
    low, high = (F.col("value") < F.col("lower")), (F.col("value") > F.col("upper"))
    plain = t.long.where("ds = 1").join(distribution.bounds(t), "feature").groupBy("feature").agg(F.count_if(low | high).alias("k"))
    got = {r["Feature"]: r["Num_Outside_Range"] for r in distribution.plausibility(t).collect()}
    assert got == {r["feature"]: r["k"] for r in plain.collect()} and max(got.values()) > 0
