"""Kendall and Spearman on complete pairs against all pairs of rows and pairwise ranks."""

import numpy as np
import pytest

from featurelens.operators import correlation
from featurelens.plans import inversions as inv
from featurelens.plans.tables import Tables
from featurelens.sources.loader import prepare
from featurelens.spec import COMPARISON, RunSpec


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def rho(x, y):
    a, b = ranks(x), ranks(y)
    return None if len(x) < 2 or a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]


def tau(x, y):
    s = np.sign(x[:, None] - x[None])
    u = np.sign(y[:, None] - y[None])
    den = np.sqrt(float((s != 0).sum()) * float((u != 0).sum()))
    return (s * u).sum() / den if den else None


def frames(spark, seed, n):
    """Two tables of columns with ties, a value of a third of the rows, shared and own nulls, and one that is constant."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(2):
        a = rng.normal(size=n)
        cols = {"a": a, "b": np.round(a + rng.normal(size=n), 1), "hot": np.where(rng.random(n) < 0.4, 0, rng.normal(size=n)),
                "few": rng.integers(0, 3, n).astype(float), "same": np.ones(n)}
        shared, own = rng.random(n) < 0.2, rng.random(n) < 0.05
        cols["m1"] = np.where(shared, np.nan, -a + 0.1 * rng.normal(size=n))
        cols["m2"] = np.where(shared, np.nan, rng.integers(0, 50, n))
        cols["own"] = np.where(own, np.nan, np.round(a * cols["few"], 1))
        rows = [(i, *[None if np.isnan(c[i]) else float(c[i]) for c in cols.values()]) for i in range(n)]
        out.append((cols, spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))))
    return out


@pytest.fixture(scope="module")
def made(spark):
    (c1, d1), (c2, d2) = frames(spark, 5, 260)
    t = Tables(prepare(d1, d2, RunSpec(rank_buckets=3, mode=COMPARISON, dataset1_name="one", dataset2_name="two")))
    return t, {"one": c1, "two": c2}


def hold(got, columns, plain):
    seen = 0
    for r in got:
        x, y = (columns[r["Dataset"]][r[f]] for f in ("Feature_1", "Feature_2"))
        both = ~np.isnan(x) & ~np.isnan(y)
        expect = plain(x[both], y[both])
        assert r["Correlation"] is None if expect is None else r["Correlation"] == pytest.approx(expect, abs=1e-12), r
        seen += 1
    p = len(columns["one"])
    assert seen == p * (p + 1)


def test_spearman_by_null_classes(made):
    t, columns = made
    classes = [sorted(t.p.features[i] for i in c) for c in correlation.null_classes(t)]
    assert sorted(classes) == [["a", "b", "few", "hot", "same"], ["m1", "m2"], ["own"]]
    hold(correlation.spearman_matrix(t).collect(), columns, rho)


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_spearman_looks_few_ranks_up_and_joins_many(made, monkeypatch, most):
    t, columns = made
    monkeypatch.setattr(correlation, "LOOKED_UP", most)
    ranks = correlation.class_ranks(t, correlation.null_classes(t))
    plan = ranks._jdf.queryExecution().optimizedPlan().toString()
    assert ("MapInArrow" in plan.split("InMemoryRelation")[0], "Join" in plan) == ((True, False) if most else (False, True))
    if not most:  # rows meet the kept counts, values are not counted again
        assert "MapInArrow" not in ranks._jdf.queryExecution().withCachedData().toString().split("InMemoryRelation")[0]
    hold(correlation.spearman_matrix(t).collect(), columns, rho)


@pytest.mark.parametrize("rows", [100_000, 60, 9])
def test_kendall_at_all_bucket_sizes(made, rows):
    t, columns = made
    hold(correlation.kendall_matrix(t, rows=rows).collect(), columns, tau)


def test_kendall_of_given_pairs(made):
    t, columns = made
    all_ = {(r["Dataset"], r["Feature_1"], r["Feature_2"]): r["Correlation"] for r in correlation.kendall_matrix(t).collect()}
    some = correlation.kendall_matrix(t, pairs=[(0, 1), (2, 5)], rows=30).collect()
    assert len(some) == 4 and all(r["Correlation"] == pytest.approx(all_[r["Dataset"], r["Feature_1"], r["Feature_2"]]) for r in some)


def test_inversions_and_ties():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(0, 30))
        x, y = (rng.integers(0, rng.integers(1, 20) + 1, n).astype(float) for _ in range(2))
        assert inv.inversions(x, y) == ((x[:, None] < x) & (y[:, None] > y)).sum()
        assert inv.tied(x, y) == (((x[:, None] == x) & (y[:, None] == y)).sum() - n) // 2
    table = rng.integers(0, 9, (5, 5)).astype(float)
    assert inv.across(table) == sum(table[u, v] * table[s, w] for u in range(5) for v in range(5)
                                    for s in range(u + 1, 5) for w in range(v))
    assert inv.bucket(np.array([0.0, 1, 1.5, 2, 3, np.nan]), np.array([1.0, 2])).tolist() == [0, 1, 2, 3, 4, -1]
