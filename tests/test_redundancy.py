"""VIFs of one factorisation against least squares per column."""

import numpy as np
import pytest

from featurelens.operators import redundancy as R
from featurelens.plans.tables import Tables
from featurelens.sources.fixtures import FIXTURES
from featurelens.sources.loader import prepare
from tests.conftest import SF_SMALL


def least_squares(x):
    """(VIF, in the span of the others) per column, without intercept."""
    vif, inf = [], []
    for i in range(x.shape[1]):
        rest, y = np.delete(x, i, axis=1), x[:, i]
        left = ((y - rest @ np.linalg.lstsq(rest, y, rcond=1e-10)[0]) ** 2).sum() / (y ** 2).sum()
        inf.append(left < 1e-12)
        vif.append(np.inf if inf[-1] else 1 / left)
    return np.array(vif), np.array(inf)


@pytest.mark.parametrize("seed", range(6))
def test_vif_of_random_columns(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(200, 7)) * 10.0 ** rng.integers(-3, 4, 7) + rng.normal(size=7)
    x[:, 1] = x[:, 0] / np.abs(x[:, 0]).max() + 0.05 * rng.normal(size=200)
    if seed % 3 > 0:
        x = np.c_[x, 2 * x[:, 2] / np.abs(x[:, 2]).max() - x[:, 3] / np.abs(x[:, 3]).max()]
    if seed % 3 > 1:
        x = np.c_[x, -3 * x[:, 4]]
    got, inf = R.vif_of_gram(x.T @ x)
    expect, dependent = least_squares(x)
    assert inf.tolist() == dependent.tolist() and inf.sum() == [0, 3, 5][seed % 3]
    assert got[~inf] == pytest.approx(expect[~inf], rel=1e-6)


def test_factorisation():
    x = np.random.default_rng(1).normal(size=(30, 5))
    s = x.T @ x
    low, order = R.pivoted_cholesky(s, 1e-12)
    assert np.allclose(low @ low.T, s[np.ix_(order, order)]) and np.allclose(low, np.tril(low))
    low, order = R.pivoted_cholesky(np.ones((4, 4)), 1e-10)
    assert low.shape == (4, 1) and sorted(order) == [0, 1, 2, 3]


def test_collinear_fixture(spark):
    t = Tables(prepare(*FIXTURES["f10"](spark, SF_SMALL)))
    rows = R.redundancy_report(t).collect()
    assert {r["Feature"] for r in rows if r["VIF_Is_Infinite"]} == {"blend", "qty_near", "qty_mid"}
    assert all(r["VIF"] == 9999 for r in rows if r["VIF_Is_Infinite"]) and len(rows) == 10
