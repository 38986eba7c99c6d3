"""Answers that were once wrong, against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelens.functions.shapiro import shapiro_wilk
from featurelens.operators import batch, multivariate, normality, quality
from featurelens.plans.tables import Tables
from featurelens.sources.fixtures import FIXTURES
from featurelens.sources.loader import prepare
from tests.conftest import SF_SMALL


def tables(spark, fx, **kw):
    d1, d2, spec = FIXTURES[fx](spark, SF_SMALL)
    return Tables(prepare(d1, d2, spec.with_(**kw) if kw else spec))


def test_one_decimal_like_python(spark):
    r = random.Random(3)
    values = [3.85, 0.05, 0.15, 0.25, 0.75, 99.95, 100.0, 2.5, 0.0] + [round(r.uniform(0, 100), 2) for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", quality._fmt1(F.col("v")).alias("t")).collect()
    assert all(x["t"] == f"{x['v']:.1f}" for x in got)


def test_combined_view_has_each_row_once(spark):
    t = tables(spark, "f6")
    counts = {r["Dataset"]: r["count"] for r in batch.combined_view(t).groupBy("Dataset").count().collect()}
    assert sorted(counts.values()) == sorted([t.p.d1.count(), t.p.d2.count()])


def test_forest_flags_above_the_linear_quantile(spark):
    t = tables(spark, "f8")
    rows = multivariate.isolation_forest_flags(t, trees=10).collect()
    c = t.spec.thresholds.outlier_contamination
    for d in (1, 2):
        scores = np.array([r["score"] for r in rows if r["ds"] == d])
        flags = sum(r["is_outlier"] for r in rows if r["ds"] == d)
        assert flags == (scores > np.quantile(scores, 1 - c)).sum()


def test_null_columns_leave_the_matrix(spark):
    t = tables(spark, "f9")
    assert t.dropped_features and not set(t.dropped_features) & set(t.matrix_features)
    assert multivariate.mahalanobis_flags(t).where("md is null or isnan(md)").count() == 0
    assert batch.batch_importance(t).count() == len(t.matrix_features)


@pytest.mark.parametrize("chunk", [7, 65_536])
def test_shapiro_over_all_values(spark, monkeypatch, chunk):
    monkeypatch.setattr(normality, "RANK_CHUNK", chunk)
    t = tables(spark, "f1")
    got = {(r["ds"], r["feature"]): r["sw"] for r in normality.shapiro(t).collect()}
    for d, df in ((1, t.p.d1), (2, t.p.d2)):
        for f in ("l_quantity", "l_extendedprice", "l_tax"):
            values = [r[0] for r in df.select(f).collect()]
            assert got[d, f] == pytest.approx(shapiro_wilk(values)[0], rel=1e-9)
