"""Record-level detectors over distinct vectors, and the rows that trees are grown on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelens.operators import multivariate
from featurelens.plans.gram import gram
from featurelens.plans.tables import Tables
from featurelens.sources.loader import prepare
from featurelens.spec import COMPARISON, RunSpec


def shared(spark, rows: int, vectors: int, nulls: bool = False) -> Tables:
    """Two datasets of ``rows`` rows that share ``vectors`` vectors, some of them far out."""
    def side(seed):
        rng = np.random.default_rng(seed)
        x = np.round(rng.normal(size=(vectors, 3)) * rng.choice([1, 6], (vectors, 1), p=[0.9, 0.1]), 2)
        x = x[rng.integers(0, vectors, rows) * rng.integers(0, 2, rows)]
        missing = nulls & (rng.random((rows, 3)) < 0.1)
        return [(i, *[None if m else float(v) for v, m in zip(r, g, strict=True)]) for i, (r, g) in enumerate(zip(x, missing, strict=True))]
    a, b = (spark.createDataFrame(side(s), "id long, a double, b double, c double") for s in (1, 2))
    return Tables(prepare(a, b, RunSpec(mode=COMPARISON, dataset1_name="one", dataset2_name="two")))


@pytest.mark.parametrize("nulls", [False, True])
def test_summary_scores_each_vector_once_and_counts_its_rows(spark, nulls):
    t = shared(spark, 1500, 120, nulls)
    got = {(r["Dataset"], r["Method"]): r["Pct_Outliers"] for r in multivariate.multivariate_outliers(t).collect()}
    assert len(got) == 6
    distinct = multivariate.scaled_matrix(t)[0].select("ds", "a", "b", "c").distinct().count()
    inputs, vc = (t.p.d1, t.p.d2), t.__dict__.get("vc")
    kept = [df.count() for df in t._held if all(df is not x for x in (*inputs, vc))]
    assert kept and max(kept) <= distinct < 3000
    assert nulls or "vc" not in t.__dict__  # no value is missing, so no median is needed
    for method, flags in (("Isolation Forest", multivariate.isolation_forest_flags(t)), ("Mahalanobis", multivariate.mahalanobis_flags(t))):
        for r in flags.groupBy("ds").agg(F.count_if("is_outlier").alias("k"), F.count(F.lit(1)).alias("n")).collect():
            assert got["one" if r["ds"] == 1 else "two", method] == pytest.approx(100 * r["k"] / r["n"], abs=0.0051)
    assert any(v > 0 for v in got.values())


def test_weighted_gram_sums_every_row(spark):
    t = shared(spark, 700, 50)
    x, v = multivariate.scaled_matrix(t)[0], multivariate.scaled_vectors(t)
    assert v.agg(F.sum("w")).first()[0] == x.count()
    rows, weighted = ({tuple(r)[:3]: tuple(r)[3:] for r in g.collect()} for g in (
        gram(x, ["a", "b", "c"], pairwise=False), gram(v, ["a", "b", "c"], pairwise=False, weight="w")))
    assert rows.keys() == weighted.keys() and all(weighted[k] == pytest.approx(rows[k], rel=1e-9, abs=1e-9) for k in rows)


def test_rows_are_offered_to_each_tree_with_its_chance(spark):
    n, trees, share = 200_000, 30, {1: 0.01, 2: 1.5}
    rows = spark.range(n).select(F.lit(1).alias("ds"), F.xxhash64("id").alias("h1"), F.hash("id").alias("h2")).unionByName(
        spark.range(50).select(F.lit(2).alias("ds"), F.xxhash64("id").alias("h1"), F.hash("id").alias("h2")))
    offers = rows.select("ds", "h1", multivariate._offered(share, trees, 42).alias("trees")).where("trees is not null").collect()
    assert all(r["trees"] == list(range(trees)) for r in offers if r["ds"] == 2) and sum(r["ds"] == 2 for r in offers) == 50
    member = np.zeros((sum(r["ds"] == 1 for r in offers), trees))
    for i, r in enumerate(r for r in offers if r["ds"] == 1):
        member[i, r["trees"]] = 1
    assert (member.sum(axis=1) > 0).all()
    both = member.T @ member
    sd = np.sqrt(n * 0.01)
    assert np.abs(np.diag(both) - n * 0.01).max() < 5 * sd
    across = both[np.triu_indices(trees, 1)]  # two trees share rows only by chance: 20 of 200,000
    assert abs(across.mean() - 20) < 2 and across.max() < 20 + 6 * np.sqrt(20)
    assert np.abs(np.bincount(member.sum(axis=1).astype(int), minlength=4)[1:4] - [n * v for v in (0.22415, 0.032831, 0.0030952)]).max() < 1100
