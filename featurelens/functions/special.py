"""Distribution functions for p-values and critical values.

There is no scipy in the runtime and no ``erf`` in Spark SQL.  Tails are computed from their definitions
(integrals by Gauss-Legendre panels, finite sums, published expansions), so that their relative error does
not grow with the sample size.  They are applied to per-feature results (p or p^2 rows) through Arrow-batched
pandas UDFs; ``log_norm_cdf_udf`` and ``norm_ppf_array`` work on whole numpy batches.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)


def erfcx(x: np.ndarray) -> np.ndarray:
    """exp(x^2) erfc(x) for x >= 0, on whole arrays.

    Below 0.5 by the series of erf; above by the trapezoidal rule for (x / pi) int exp(-t^2) / (x^2 + t^2) dt with steps of 1/2,
    whose error beyond the pole's term is exp(-4 pi^2) (Chiarella and Reichel, 1968).
    """
    x = np.asarray(x, float)
    out = np.empty(x.shape)
    small = x < 0.5
    v = x[small]
    term, total = v.copy(), v.copy()
    for k in range(1, 16):
        term = -term * v * v / k
        total += term / (2 * k + 1)
    out[small] = np.exp(v * v) * (1 - 2 / math.sqrt(math.pi) * total)
    v = x[~small]
    k = np.arange(1, 14)[:, None] * 0.5
    square = v * v
    total = 1 / square + 2 * (np.exp(-k * k) / (k * k + square)).sum(axis=0)
    near = np.minimum(v, 6.0)  # beyond, the pole adds less than the last digit
    pole = np.where(v < 6.0, np.exp(near * near) * 2 / np.expm1(4 * math.pi * near), 0.0)
    out[~small] = 0.5 * v / math.pi * total - pole
    return out


def norm_sf(z) -> np.ndarray:
    """Upper tail of the standard normal law, to full relative accuracy."""
    z = np.asarray(z, dtype=float)
    x = np.abs(z) / math.sqrt(2.0)
    with np.errstate(under="ignore"):
        tail = np.where(np.isinf(x), 0.0, 0.5 * np.exp(-np.minimum(x, 40.0) ** 2) * erfcx(np.nan_to_num(x, posinf=1e9)))
    tail = np.where(x > 39.0, 0.0, tail)
    return np.where(np.isnan(z), np.nan, np.where(z >= 0, tail, 1.0 - tail))


def log_norm_cdf(z) -> np.ndarray:
    """log Phi(z), accurate in both tails."""
    z = np.asarray(z, dtype=float)
    low = -0.5 * z * z + np.log(0.5 * erfcx(np.abs(z) / math.sqrt(2.0)))
    return np.where(z < 0, low, np.log1p(-norm_sf(np.maximum(z, 0.0))))


def norm_cdf(z) -> np.ndarray:
    return norm_sf(-np.asarray(z, dtype=float))


def norm_ppf(p: float) -> float:
    """Standard normal quantile."""
    if 0.0 < p < 1.0:
        return NormalDist().inv_cdf(p)
    return float("-inf") if p <= 0.0 else float("inf")


# Coefficients of Wichura's algorithm AS 241 (1988), constant term first.
_CENTRE = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
           4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_CENTRE_DOWN = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
                2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_TAIL = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
         1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_TAIL_DOWN = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
              1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_FAR = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
        2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_FAR_DOWN = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
             7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def norm_ppf_array(p: np.ndarray) -> np.ndarray:
    """Standard normal quantiles of 0 < p < 1 on whole arrays."""
    p = np.asarray(p, float)
    q = p - 0.5

    def ratio(up, down, r):
        return np.polynomial.polynomial.polyval(r, up) / np.polynomial.polynomial.polyval(r, down)

    r = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    tail = np.where(r <= 5.0, ratio(_TAIL, _TAIL_DOWN, r - 1.6), ratio(_FAR, _FAR_DOWN, r - 5.0))
    return np.where(np.abs(q) <= 0.425, q * ratio(_CENTRE, _CENTRE_DOWN, 0.180625 - q * q), np.copysign(tail, q))


def _cosine_tail(exponent: float, start: float) -> tuple[float, float]:
    """Integral of (cos u / cos start)^exponent from ``start`` to pi/2, and log cos start.

    Panels double in width from the integrand's own scale, so the same number of nodes serves all exponents."""
    log_start = -0.5 * math.log1p(math.tan(start) ** 2)
    scale = min(1.0 / (1.0 + math.sqrt(exponent)), 1.0 / (1.0 + exponent * math.tan(start)))
    edges, step = [start], scale
    while edges[-1] < math.pi / 2:
        edges.append(min(edges[-1] + step, math.pi / 2))
        step *= 2
    low, high = np.array(edges[:-1])[:, None], np.array(edges[1:])[:, None]
    u = (low + high) / 2 + (high - low) / 2 * _NODES
    value = np.exp(exponent * (-0.5 * np.log1p(np.tan(u) ** 2) - log_start))
    return float(((high - low) / 2 * _WEIGHTS * value).sum()), log_start


def t_sf2(t: float, df: float) -> float:
    """Two-sided Student-t tail probability P(|T| > |t|).

    With t = sqrt(df) tan u the density is proportional to cos(u)^(df - 1) on (-pi/2, pi/2)."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df < 1:
        return float("nan")
    if math.isinf(t):
        return 0.0
    if df == 1:
        return 1.0 - 2.0 / math.pi * math.atan(abs(t)) if abs(t) < 1 else 2.0 / math.pi * math.atan(1.0 / abs(t))
    tail, log_start = _cosine_tail(df - 1.0, math.atan2(abs(t), math.sqrt(df)))
    whole, _ = _cosine_tail(df - 1.0, 0.0)
    return min(1.0, math.exp((df - 1.0) * log_start) * tail / whole)


def _expansion(z: float, n: float) -> float:
    """P(sqrt(n) D_n <= z) by the expansion of Pelz and Good (1976) up to n^(-3/2)."""
    k = np.arange(0, 60)
    half, pi2 = ((k + 0.5) ** 2), math.pi ** 2
    near = 2.0 * np.exp(-pi2 * half / (2 * z * z))  # terms k + 1/2 and -(k + 1/2)
    whole = 2.0 * np.exp(-pi2 * k[1:] ** 2 / (2 * z * z))
    square, root = k[1:] ** 2.0, math.sqrt(math.pi / 2)
    z2, z4, z6 = z ** 2, z ** 4, z ** 6
    k0 = 2 * root / z * (near / 2).sum()
    k1 = root / (6 * z4) * ((pi2 * half - z2) * near).sum()
    k2 = root / (72 * z ** 7) * ((6 * z6 + 2 * z4 + pi2 * (2 * z4 - 5 * z2) * half
                                  + pi2 ** 2 * (1 - 2 * z2) * half ** 2) * near).sum()
    k2 -= root / (36 * z ** 3) * (pi2 * square * whole).sum()
    k3 = root / (6480 * z ** 10) * ((pi2 ** 3 * half ** 3 * (5 - 30 * z2) + pi2 ** 2 * half ** 2 * (212 * z4 - 60 * z2)
                                     + pi2 * half * (135 * z4 - 96 * z6) - (30 * z6 + 90 * z ** 8)) * near).sum()
    k3 += root / (216 * z6) * ((3 * pi2 * square * z2 - pi2 ** 2 * square ** 2) * whole).sum()
    return k0 + k1 / math.sqrt(n) + k2 / n + k3 / n ** 1.5


def _stirling(x: np.ndarray) -> np.ndarray:
    """log Gamma(x + 1) less its leading terms (x + 1/2) log x - x + log(2 pi)/2, for x >= 0 (0 at 0)."""
    small = np.array([0.0] + [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi)
                              for i in range(1, 16)])
    y = np.maximum(x, 16.0)
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    return np.where(x < 16, small[np.minimum(x, 15).astype(int)], series)


def _one_sided(d: float, n: int) -> float:
    """P(D_n^+ >= d), the finite sum of Birnbaum and Tingey (1951).

    A term is a binomial probability; its logarithm is taken through deviances, which do not cancel."""
    j = np.arange(0, int(math.floor(n * (1.0 - d))) + 1, dtype=float)
    p, q = d + j / n, 1.0 - d - j / n
    keep = q > 0
    j, p, q = j[keep], p[keep], q[keep]
    m = n - j

    def deviance(count, share):
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (count - n * share) / (n * share)
            return np.where(count > 0, count * np.log1p(ratio) - (count - n * share), n * share)

    log = _stirling(np.array([float(n)]))[0] - _stirling(j) - _stirling(m) - deviance(j, p) - deviance(m, q)
    log += 0.5 * (math.log(n) - np.log(np.maximum(j, 1 / (2 * math.pi))) - np.log(np.maximum(m, 1 / (2 * math.pi))))
    log += np.where((j > 0) & (m > 0), -0.5 * math.log(2 * math.pi), 0.0)
    log += np.where((j == 0) & (m > 0) | (j > 0) & (m == 0), -0.5 * math.log(2 * math.pi), 0.0)
    return float(d * np.exp(log - np.log(p)).sum())


#: Largest n whose tail is summed term by term (its cost is n); beyond it the asymptotic formula's
#: relative error is 1.1e-9 at sqrt(n) d = 2.5 and grows to 4.2e-5 at 12 (both at n = 1,000,000).
FINITE_SUM = 1_000_000


def kolmogorov_sf(d: float, n: float) -> float:
    """P(D_n >= d) of the two-sided one-sample statistic for ``n`` observations (n -> infinity: its limit).

    Above sqrt(n) d = 1.8 it is twice the one-sided tail: both at once are rarer by exp(-6 n d^2)."""
    if d is None or n is None or math.isnan(d) or math.isnan(n) or n <= 0:
        return float("nan")
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    z = math.sqrt(n) * d
    if z > 1.8:
        if n <= FINITE_SUM:
            return min(1.0, 2.0 * _one_sided(d, int(n)))
        s = (6 * n * d + 1) ** 2 / (18 * n)  # one-sided tail with its first correction, Maag and Dicaire (1971)
        return min(1.0, 2.0 * math.exp(-s) * (1.0 - (2 * s * s - 4 * s - 1) / (18 * n)))
    return min(1.0, max(0.0, 1.0 - _expansion(z, n)))


def ks_two_sample_sf(d: float, n1: float, n2: float) -> float:
    """P(D >= d) of two samples of ``n1`` and ``n2`` untied values, exactly.

    Orders of the pooled sample are lattice paths from (0, 0) to (n1, n2), all equally likely; D >= d if a path leaves the band
    |i/n1 - j/n2| < d.  The share of the paths to (i, j) that have left it is a mean of the shares of its two
    predecessors, with weights i/(i + j) and j/(i + j): sums of positive numbers, so small tails keep their digits.
    Only the band is held, a diagonal at a time; the work is about 2 d n1 n2."""
    n1, n2 = int(n1), int(n2)
    if n1 < 1 or n2 < 1 or math.isnan(d):
        return float("nan")
    g = math.gcd(n1, n2)
    a, b = n1 // g, n2 // g  # D is a whole multiple of 1 / (g a b)
    h = round(d * n1 * b)
    if h <= 0:
        return 1.0
    low, share = 0, np.zeros(1)
    for s in range(1, n1 + n2 + 1):
        first = max(0, s - n2, -((h - 1 - s * a) // (a + b)))
        last = min(s, n1, (s * a + h - 1) // (a + b))
        if first > last:
            return 1.0
        around = np.concatenate(([1.0], share, [1.0]))[first - low:last - low + 2]  # outside the band all paths have left it
        i = np.arange(first, last + 1)
        share = (i * around[:-1] + (s - i) * around[1:]) / s
        low = first
    return float(min(1.0, share[0]))


def chi2_sf(x: float, k: int) -> float:
    """P(X > x) for ``k`` degrees of freedom: the finite sum in half steps of k (DLMF 8.4.8, 8.4.10, 8.8.2)."""
    if x <= 0:
        return 1.0
    h = x / 2.0
    first = 0.0 if k % 2 == 0 else 0.5
    s = math.exp(-h) if k % 2 == 0 else math.erfc(math.sqrt(h))
    for i in range(1, k // 2 + (k % 2)):
        j = i if k % 2 == 0 else i - 1 + first
        s += math.exp(j * math.log(h) - h - math.lgamma(j + 1))
    return min(1.0, s)


def chi2_ppf(q: float, df: float) -> float:
    """Chi-square quantile for whole ``df`` by bisection."""
    k, lo, hi = int(df), 0.0, max(10.0, 2.0 * df)
    while 1.0 - chi2_sf(hi, k) < q:
        hi *= 2.0
    while hi - lo > 1e-14 * hi:
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if chi2_sf(mid, k) > 1.0 - q else (lo, mid)
    return 0.5 * (lo + hi)


def wilcoxon_exact_p(w: float, n: int) -> float:
    """Two-sided exact p of the signed-rank statistic min(W+, W-) for n untied, non-zero differences.

    Shares of subsets of {1..n} by rank sum (dynamic programming over n(n+1)/2
    sums) give P(W+ <= w); p = min(1, 2 P(W+ <= w)).
    """
    n = int(n)
    total = n * (n + 1) // 2
    c = np.zeros(total + 1)
    c[0] = 1.0
    for k in range(1, n + 1):  # shares of 2^k subsets, so that no count overflows
        c *= 0.5
        c[k:] += c[:-k].copy()
    cdf = c[: int(math.floor(w)) + 1].sum()
    return float(min(1.0, 2.0 * cdf))


# ---------------------------------------------------------------- pandas UDFs
def _each(f, *columns: pd.Series) -> pd.Series:
    rows = zip(*[c.astype(float) for c in columns], strict=True)
    return pd.Series([f(*r) if not any(math.isnan(v) for v in r) else np.nan for r in rows], dtype=float)


@F.pandas_udf(T.DoubleType())
def norm_sf_udf(z: pd.Series) -> pd.Series:
    return pd.Series(norm_sf(z.astype(float).to_numpy()))


@F.pandas_udf(T.DoubleType())
def t_sf2_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_sf2, t, df)


@F.pandas_udf(T.DoubleType())
def kolmogorov_sf_udf(d: pd.Series, n: pd.Series) -> pd.Series:
    return _each(kolmogorov_sf, d, n)


@F.pandas_udf(T.DoubleType())
def ks_two_sample_sf_udf(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _each(ks_two_sample_sf, d, n1, n2)


@F.pandas_udf(T.DoubleType())
def norm_ppf_udf(p: pd.Series) -> pd.Series:
    return _each(norm_ppf, p)


@F.pandas_udf(T.DoubleType())
def log_norm_cdf_udf(z: pd.Series) -> pd.Series:
    return pd.Series(log_norm_cdf(z.astype(float).to_numpy()))


@F.pandas_udf(T.DoubleType())
def wilcoxon_exact_p_udf(w: pd.Series, n: pd.Series) -> pd.Series:
    return _each(wilcoxon_exact_p, w, n)
