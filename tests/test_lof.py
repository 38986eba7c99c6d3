"""Exact k-nearest-neighbour join and Local Outlier Factor against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelens.operators import lof, multivariate
from featurelens.plans import knn
from featurelens.plans.store import written
from featurelens.plans.tables import Tables
from featurelens.sources.loader import prepare
from featurelens.spec import COMPARISON, RunSpec


def all_pairs(x, w, k):
    """(edges, k-distances) over distinct points with weights."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    weight = np.broadcast_to(w, d.shape) - np.eye(len(x), dtype=int)
    kd = np.empty(len(x))
    for i in range(len(x)):
        order = np.argsort(d[i], kind="stable")
        kd[i] = d[i][order][np.argmax(np.cumsum(weight[i][order]) >= k)]
    near = (d <= kd[:, None] * knn.TIE) & (weight > 0)
    return d, weight, near, kd


def factor(x, w, k):
    d, weight, near, kd = all_pairs(x, w, k)
    weight = np.where(near, weight, 0)
    lrd = 1 / ((weight * np.maximum(d, kd[None, :])).sum(1) / weight.sum(1) + 1e-10)
    return (weight * lrd[None, :]).sum(1) / weight.sum(1) / lrd


@pytest.mark.parametrize("dims,n,cell", [(1, 400, 30), (2, 900, 50), (3, 600, 40), (8, 300, 60)])
def test_join_over_many_cells(spark, dims, n, cell):
    rng = np.random.default_rng(dims)
    data = []
    for ds in (1, 2):
        x = rng.normal(size=(n, dims)) * rng.choice([0.05, 1, 4], (n, 1))  # dense and empty places
        x = np.unique(np.round(x, 2), axis=0)
        data += [(ds, v.tolist(), int(m)) for v, m in zip(x, rng.integers(1, 5, len(x)), strict=True)]
    points = written(spark.createDataFrame(data, "ds int, x array<double>, w long"), "points")
    numbered, edges, visits = knn.neighbours(points, dims, 7, cell)
    name = {(r["ds"], r["cell"], r["at"]): tuple(r["x"]) for r in numbered.collect()}
    assert len(name) == len(data) and len({k[:2] for k in name}) > 6
    got = {(r["ds"], name[r["ds"], r["cell"], r["at"]], name[r["ds"], r["ocell"], r["oat"]]): (r["d"], r["w"], r["kd"])
           for r in edges.collect()}
    expect = {}
    for ds in (1, 2):
        x = np.array([d[1] for d in data if d[0] == ds])
        w = np.array([d[2] for d in data if d[0] == ds])
        d, weight, near, kd = all_pairs(x, w, 7)
        for i, j in zip(*np.nonzero(near), strict=True):
            expect[ds, tuple(x[i]), tuple(x[j])] = (d[i, j], weight[i, j], kd[i])
    assert got.keys() == expect.keys()
    assert all(got[e] == pytest.approx(expect[e], rel=1e-12) for e in got)
    if dims < 3:
        assert visits.count() < 2 * len(data)  # far from all pairs of points and cells


def test_visits_grow_with_the_points(spark):
    rng = np.random.default_rng(9)
    counts = []
    for n in (2000, 8000):
        points = written(spark.createDataFrame([(1, v.tolist(), 1) for v in rng.normal(size=(n, 2))],
                                               "ds int, x array<double>, w long"), "points")
        counts.append(knn.neighbours(points, 2, 10, 100)[2].count())
    assert counts[1] < 6 * counts[0] and counts[1] < 2 * 8000  # all pairs of points and cells: a million


def test_factor_with_a_vector_that_a_third_of_the_rows_share(spark):
    rng = np.random.default_rng(4)
    value = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.normal(size=(300, 2)), 3))]
    value += [(1000 + i, 0.25, -0.5) for i in range(150)] + [(2000, 9.0, 9.0), (2001, None, 0.125)]
    frame = spark.createDataFrame(value, "id long, a double, b double")
    few = frame.limit(40)  # too few rows for the detectors
    t = Tables(prepare(frame, few, RunSpec(rank_buckets=3, mode=COMPARISON, dataset1_name="one", dataset2_name="few")))
    x, _ = multivariate.scaled_matrix(t)
    rows = x.where("ds = 1").select("id", "a", "b").collect()
    vectors = np.array([(r["a"], r["b"]) for r in rows])
    distinct, back, weight = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
    expect = factor(distinct, weight, 20)[back.ravel()]
    for cell in (knn.CELL, 25):
        got = {r["id"]: r for r in lof.lof_rows(t, x, cell=cell).collect()}
        assert len(got) == len(rows)
        assert [got[r["id"]]["lof"] for r in rows] == pytest.approx(expect.tolist(), rel=1e-9)
        limit = np.quantile(expect, 0.99)
        assert [got[r["id"]]["is_outlier"] for r in rows] == (expect > limit * knn.TIE).tolist()
    assert multivariate.multivariate_outliers(t, ("LOF",)).collect()[0]["Pct_Outliers"] == pytest.approx(
        round((expect > limit * knn.TIE).mean() * 100, 2))


def test_projection_names_all_three_detectors(spark):
    from featurelens.sources.fixtures import FIXTURES
    from tests.conftest import SF_SMALL

    d1, d2, spec = FIXTURES["f8"](spark, SF_SMALL)
    t = Tables(prepare(d1, d2, spec))
    assert multivariate.multivariate_outliers(t).groupBy("Method").count().count() == 3
    x, _ = multivariate.scaled_matrix(t)
    flags = lof.lof_rows(t, x).agg(F.count_if("is_outlier").alias("k"), F.count("lof").alias("n")).first()
    assert 0 < flags["k"] < 0.02 * flags["n"]


def test_a_column_that_one_value_fills_is_still_cut(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 3))
    x[:, 0] = np.where(rng.random(4000) < 0.99, 0.0, 12.0)  # the widest column, and its median is its least value
    sizes = np.bincount(knn.Cells(x, 16).of(x), minlength=16)
    assert sizes.max() <= 3 * 4000 / 16
    both = knn.Cells(np.repeat([[0.0, 1.0], [0.0, 2.0]], [9, 1], axis=0), 2)
    assert np.bincount(both.of(np.array([[0.0, 1.0], [0.0, 2.0]]))).tolist() == [1, 1]


def test_wide_search_measures_few_pairs_and_is_exact(monkeypatch):
    rng = np.random.default_rng(2)
    measured = []
    exact = knn.paired
    monkeypatch.setattr(knn, "paired", lambda a, b: (measured.append(len(a)), exact(a, b))[1])
    for shift in (0.0, 1e6):  # far from the origin, matrix products of raw coordinates would cancel
        measured.clear()
        x = np.unique(rng.normal(size=(1500, 40)) + shift, axis=0)
        w = rng.integers(1, 4, len(x))
        d, weight, near, kd = all_pairs(x, w, 9)
        row, at, far, weights, reach = knn.within(x, np.full(len(x), np.inf), x, w, 9, True)
        assert set(zip(row.tolist(), at.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(near)), strict=True))
        assert far == pytest.approx(d[row, at], rel=1e-12) and (weights == weight[row, at]).all()
        assert reach == pytest.approx(kd, rel=1e-12)
        assert sum(measured) < 0.1 * len(x) ** 2


def test_forest_paths_in_full_trees():
    rng = np.random.RandomState(3)
    x = np.round(rng.normal(size=(300, 3)), 1)

    def walked(row, nodes):
        at, depth = 0, 0
        while nodes[at][0] >= 0:
            at, depth = nodes[at][2 if row[nodes[at][0]] < nodes[at][1] else 3], depth + 1
        return depth + multivariate._c([nodes[at][4]])[0]

    for some in (x[:1], x[:5], x[:256]):
        nodes = multivariate._grow(some, rng, 8)
        got = multivariate._path_lengths(x, multivariate._paths(nodes, 8), 8)
        assert got.tolist() == [walked(r, nodes) for r in x]
