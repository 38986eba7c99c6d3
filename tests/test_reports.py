"""Reports against brute-force numpy versions of the published formulas."""

import csv
import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from featurelens.operators import compare, paired, quality
from featurelens.plans.tables import Tables
from featurelens.sources.fixtures import FIXTURES
from featurelens.sources.loader import prepare
from tests.conftest import SF_SMALL


def _tables(spark, fx, sf=SF_SMALL, **kw):
    d1, d2, spec = FIXTURES[fx](spark, sf)
    if kw:
        spec = spec.with_(**kw)
    return Tables(prepare(d1, d2, spec))


def _shares(sample, edges):
    """Share of the sample in each cell of ``edges``; cells are closed below, the last one on both sides."""
    below = np.searchsorted(np.sort(sample), edges[1:-1], side="left")
    return np.diff(np.concatenate(([0], below, [len(sample)]))) / len(sample)


def _entropy(p):
    return -sum(v * math.log(v) for v in p if v > 0)


def _expected_similarity(a, b, cells=100):
    """Overlap as one minus half the total variation; divergence as the entropy gained by mixing (densities
    are lifted by 1e-10 before); KS from the two step functions walked together."""
    edges = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), cells + 1)
    sa, sb = _shares(a, edges), _shares(b, edges)
    lifted = [s / (edges[1] - edges[0]) + 1e-10 for s in (sa, sb)]
    pa, pb = (s / s.sum() for s in lifted)
    gain = _entropy((pa + pb) / 2) - (_entropy(pa) + _entropy(pb)) / 2
    steps = sorted([(v, 1 / len(a)) for v in a] + [(v, -1 / len(b)) for v in b])
    height = widest = 0.0
    for i, (v, step) in enumerate(steps):
        height += step
        if i + 1 == len(steps) or steps[i + 1][0] != v:
            widest = max(widest, abs(height))
    return 1 - np.abs(sa - sb).sum() / 2, gain, widest


def test_similarity_matches_numpy(spark):
    t = _tables(spark, "f8")
    row = compare.similarity_stats(t).collect()[0]
    ev = pq.read_table(f"{SF_SMALL}/events.parquet").to_pandas()
    x = ev.loc[ev.event_type == "view", "value"].to_numpy()
    y = ev.loc[ev.event_type == "purchase", "value"].to_numpy()
    overlap, jsd, ks = _expected_similarity(x, y)
    assert row["KS_Statistic"] == pytest.approx(ks, rel=1e-9)
    assert row["JS_Divergence"] == pytest.approx(jsd, rel=1e-9)
    score = ((1 - min(jsd, 1)) * 0.4 + overlap * 0.4 + (1 - ks) * 0.2) * 100
    assert row["Similarity_Score"] == pytest.approx(score, rel=1e-9)


def test_number_of_ranges_does_not_matter(spark):
    a = _tables(spark, "f1", rank_buckets=1)
    b = _tables(spark, "f1", rank_buckets=50)
    ra = sorted(tuple(r) for r in compare.comparison_stats(a).collect())
    rb = sorted(tuple(r) for r in compare.comparison_stats(b).collect())
    assert len(ra) == len(rb) == 4
    for x, y in zip(ra, rb):
        assert x[0] == y[0]
        for u, v in zip(x[1:], y[1:]):
            assert u == pytest.approx(v, rel=1e-9, abs=1e-12) if isinstance(u, float) else u == v


def test_identical_pair_agrees_perfectly(spark):
    t = _tables(spark, "f6")
    r = paired.paired_stats(t).collect()[0]
    assert r["ICC"] == pytest.approx(1.0)
    assert r["MAE"] == 0 and r["RMSE"] == 0 and r["Mean_Diff"] == 0
    assert r["Agreement"] == "Excellent"
    assert r["Wilcoxon_stat"] is None  # all differences are zero


def test_quality_score_bounds(spark):
    t = _tables(spark, "f9")
    rows = quality.quality_score(t).collect()
    assert {r["Feature"] for r in rows} >= {"k_const", "k_null", "k_near"}
    by = {r["Feature"]: r for r in rows}
    assert "Constant" in by["k_const"]["Primary_Issues"]
    assert all(0 <= r["Quality_Score"] <= 100 for r in rows)


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 1
    assert "Similarity_Score" in df.columns


def test_anderson_darling_matches_brute_force(spark):
    import math

    from featurelens.operators import normality

    t = _tables(spark, "f1")
    got = {(r["ds"], r["feature"]): r["ad"] for r in normality.anderson_darling(t).collect()}
    li = pq.read_table(f"{SF_SMALL}/lineitem.parquet").to_pandas()
    x = np.sort(li.loc[li.l_linestatus == "F", "l_quantity"].to_numpy())  # many ties
    n = len(x)
    z = (x - x.mean()) / x.std(ddof=1)
    lcdf = np.array([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in z])
    lsf = np.array([math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in z])
    i = np.arange(1, n + 1)
    a2 = -n - np.sum((2 * i - 1.0) / n * (lcdf + lsf[::-1]))
    assert got[(1, "l_quantity")] == pytest.approx(a2, rel=1e-9)


def test_shapiro_on_expected_normal_order_statistics():
    from featurelens.functions.shapiro import shapiro_wilk
    from featurelens.functions.special import norm_ppf

    n = 200
    m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    w, p = shapiro_wilk(m)
    assert w > 0.999 and p > 0.9
    w2, p2 = shapiro_wilk(np.exp(m))  # log-normal: clearly not normal
    assert w2 < 0.9 and p2 < 1e-6
