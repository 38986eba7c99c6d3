"""Special functions against tabulated values (public tables / closed forms)."""

import math
from fractions import Fraction

import numpy as np
import pytest

from featurelens.functions import special as S


def test_norm_sf():
    assert S.norm_sf([0.0])[0] == pytest.approx(0.5)
    assert S.norm_sf([1.959963984540054])[0] == pytest.approx(0.025, rel=1e-12)
    assert S.norm_sf([-1.0])[0] == pytest.approx(0.8413447460685429, rel=1e-12)


def test_t_two_sided():
    # P(|T| > 2.228138851986274) = 0.05 for 10 degrees of freedom
    assert S.t_sf2(2.228138851986274, 10) == pytest.approx(0.05, rel=1e-9)
    # df = 1 is Cauchy: P(|T| > 1) = 0.5
    assert S.t_sf2(1.0, 1) == pytest.approx(0.5, rel=1e-12)


def test_kolmogorov():
    # far n: the limit Q(z) = 2 sum (-1)^(k-1) exp(-2 k^2 z^2); Q(1.358098) ~ 0.05
    n = 1e12
    assert S.kolmogorov_sf(1.3580986393225505 / math.sqrt(n), n) == pytest.approx(0.05, rel=1e-5)
    assert S.kolmogorov_sf(0.5 / math.sqrt(n), n) == pytest.approx(0.9639452436648751, rel=1e-6)
    # published value for n = 10: P(D < 0.274) = 0.628479615456504
    assert S.kolmogorov_sf(0.274, 10) == pytest.approx(1 - 0.628479615456504, rel=1e-4)
    # the one-sided sum at n = 2: P(D+ >= d) = (1 - d)^2 + 2 d (1/2 - d) (1 - d)^0 ... = 0.61 at 0.3
    assert S._one_sided(0.3, 2) == pytest.approx(0.61, rel=1e-12)
    assert S.kolmogorov_sf(0.1, 10_000) == pytest.approx(2 * S._one_sided(0.1, 10_000), rel=1e-12)


def test_one_sided_by_exact_sums():
    """P(D+ >= d) = d sum_j C(n, j) (d + j/n)^(j-1) (1 - d - j/n)^(n-j) over j <= n (1 - d), in fractions."""
    for n in (1, 2, 5, 20, 60):
        for d in (Fraction(1, 10), Fraction(3, 10), Fraction(1, 2), Fraction(9, 10)):
            total = sum(math.comb(n, j) * (d + Fraction(j, n)) ** (j - 1) * (1 - d - Fraction(j, n)) ** (n - j)
                        for j in range(n + 1) if Fraction(j, n) <= 1 - d)
            assert S._one_sided(float(d), n) == pytest.approx(float(d * total), rel=1e-11)


def test_chi2_and_norm_ppf():
    assert S.chi2_ppf(0.95, 1) == pytest.approx(3.841458820694124, rel=1e-9)
    assert S.chi2_ppf(0.999, 70) == pytest.approx(112.317, rel=1e-5)
    assert S.chi2_ppf(0.999, 60) == pytest.approx(99.607, rel=1e-5)
    assert S.norm_ppf(0.975) == pytest.approx(1.959963984540054, rel=1e-12)
    assert S.norm_ppf(0.5) == pytest.approx(0.0, abs=1e-15)


def test_t_tails_keep_their_digits():
    assert math.isnan(S.t_sf2(float("nan"), 3))
    for t in (0.1, 1.0, 3.0, 10.0):  # closed forms for 1, 2 and 4 degrees of freedom
        assert S.t_sf2(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-12)
        assert S.t_sf2(t, 2) == pytest.approx(2 / (math.sqrt(2 + t * t) * (math.sqrt(2 + t * t) + t)), rel=1e-12)
        c = t / math.sqrt(t * t + 4)
        assert S.t_sf2(t, 4) == pytest.approx(1 - c * (3 - c * c) / 2, rel=1e-9)
    for t in (0.5, 3.0, 20.0):
        assert S.t_sf2(t, 1e13) == pytest.approx(2 * S.norm_sf([t])[0], rel=1e-7)


def test_wilcoxon_exact():
    # n = 10: P(W+ <= 8) = 25 / 1024 (the tabulated two-sided 5% critical value is 8)
    assert S.wilcoxon_exact_p(8, 10) == pytest.approx(2 * 25 / 1024)
    assert S.wilcoxon_exact_p(27.5, 10) == 1.0
    # symmetric distribution: P(W+ <= n(n+1)/4) >= 1/2
    assert S.wilcoxon_exact_p(10.5, 6) == 1.0


def test_normal_functions_on_whole_arrays():
    z = np.linspace(-37, 37, 4001)
    assert np.max(np.abs(S.norm_sf(z) / [0.5 * math.erfc(x / math.sqrt(2)) for x in z] - 1)) < 1e-12
    assert np.max(np.abs(S.erfcx(np.linspace(0, 5, 999)) / [math.exp(x * x) * math.erfc(x) for x in np.linspace(0, 5, 999)] - 1)) < 1e-12
    low = z[z < 0]
    assert np.max(np.abs(S.log_norm_cdf(low) / [math.log(0.5 * math.erfc(-x / math.sqrt(2))) for x in low] - 1)) < 1e-12
    far = -1000.0  # log Phi(z) = -z^2/2 - log(-z sqrt(2 pi)) + log(1 - 1/z^2 + 3/z^4 ...)
    assert S.log_norm_cdf([far])[0] == pytest.approx(-far * far / 2 - math.log(-far * math.sqrt(2 * math.pi)) - 1 / far ** 2, rel=1e-13)
    assert S.norm_sf([math.nan, math.inf, -math.inf]).tolist()[1:] == [0.0, 1.0]
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 3001), 10.0 ** -np.arange(1, 290, 9)])
    x = S.norm_ppf_array(p)
    assert np.max(np.abs(S.norm_sf(-x[p < 0.5]) / p[p < 0.5] - 1)) < 1e-12
    assert np.max(np.abs(x[:3001] - [S.norm_ppf(v) for v in p[:3001]])) < 1e-12


def test_wilcoxon_exact_beyond_the_range_of_counts():
    # far from the mean, for n large, against the normal law with a tolerance of its error
    n = 1100
    mean, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    w = mean - 2 * sd
    assert S.wilcoxon_exact_p(w, n) == pytest.approx(2 * S.norm_sf([2.0])[0], rel=5e-3)


def test_two_sample_law_by_enumeration():
    from itertools import combinations

    for n1, n2 in ((1, 1), (1, 5), (3, 3), (4, 6), (5, 8), (8, 8), (7, 4)):
        far = []
        for first in combinations(range(n1 + n2), n1):
            i = j = top = 0
            for at in range(n1 + n2):
                i, j = (i + 1, j) if at in first else (i, j + 1)
                top = max(top, abs(i * n2 - j * n1))
            far.append(top)
        for h in sorted(set(far)):
            want = sum(x >= h for x in far) / len(far)
            assert S.ks_two_sample_sf(h / n1 / n2, n1, n2) == pytest.approx(want, rel=1e-12)
    assert S.ks_two_sample_sf(0.0, 4, 5) == 1.0
    assert S.ks_two_sample_sf(1.0, 300, 400) == pytest.approx(2 / math.comb(700, 300), rel=1e-9)
    # many values: the limit law
    assert S.ks_two_sample_sf(0.03, 20_000, 15_000) == pytest.approx(S.kolmogorov_sf(0.03, 20_000 * 15_000 / 35_000), rel=0.02)
