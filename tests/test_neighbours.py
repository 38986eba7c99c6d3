"""What the neighbour search writes, and its screening over many scales."""

import numpy as np
import pytest

from featurelens.operators import lof, multivariate
from featurelens.plans import knn, store
from featurelens.plans.tables import Tables
from featurelens.sources.loader import prepare
from featurelens.spec import COMPARISON, RunSpec
from tests.test_lof import all_pairs, factor


def test_pairs_of_neighbours_are_never_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    counts, plain = {}, store.written

    def noted(df, name):
        out = plain(df, name)
        counts[name] = out.count()
        return out

    for module in (store, lof, multivariate):
        monkeypatch.setattr(module, "written", noted)
    value = np.unique(np.round(rng.normal(size=(1500, 2)), 3), axis=0)
    a = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(value)], "id long, a double, b double")
    t = Tables(prepare(a, a.limit(20), RunSpec(mode=COMPARISON, dataset1_name="one", dataset2_name="few")))
    got = sorted(r["lof"] for r in lof.lof_flags(t, cell=300).collect())
    x = np.array([[r["a"], r["b"]] for r in multivariate.scaled_vectors(t).where("ds = 1").collect()])
    assert got == pytest.approx(sorted(factor(x, np.ones(len(x), int), 20)), rel=1e-9)
    assert counts["halo"] > 0 and max(counts.values()) < 1.2 * len(value)  # 20 pairs and more for each point


@pytest.mark.parametrize("own", [True, False])
def test_screening_is_exact_over_many_scales(own):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(900, 3)) * 1e-21, 5 + rng.normal(size=(900, 3)) * 1e-9, rng.normal(size=(900, 3)),
                        rng.normal(size=(40, 3)) * 1e3, rng.integers(0, 6, (300, 3)) / 4])
    x = np.unique(x, axis=0)
    w = rng.integers(1, 3, len(x))
    d, weight, near, kd = all_pairs(x, w, 9)
    bound = knn.within(x, np.full(len(x), np.inf), x, w, 9, True, 1)[-1]
    assert (bound >= kd).all() and np.median(bound / kd) < 1.5
    inside = np.arange(len(x)) if own else rng.permutation(len(x))[:700]
    if own:
        row, at, far, weights, reach = knn.within(x, bound, x, w, 9, True)
        assert reach == pytest.approx(kd, rel=1e-12) and (weights == weight[row, at]).all()
        expect = near
    else:  # points of elsewhere, with their bounds
        row, at, far, weights, reach = knn.within(x[inside], kd[inside], x, w, 9, False)
        expect = d[inside] <= np.minimum(kd[inside], reach)[:, None] * knn.TIE
    assert set(zip(row.tolist(), at.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(expect)), strict=True))
    assert far == pytest.approx(d[inside[row], at], rel=1e-12)
