"""Shapiro-Wilk W and p-value (Royston 1995, algorithm AS R94), numpy only.

W is computed over all values from sums that Spark gathers (``operators.normality``).  The p-value's
polynomials were calibrated by their author for 12 to 5,000 values; beyond, it is an extrapolation.
Only the n >= 12 branch is needed: the normality report requires at least 20 values.
"""

from __future__ import annotations

import math

import numpy as np

from .special import norm_ppf, norm_ppf_array, norm_sf

# Polynomial coefficients of AS R94 (Royston 1995).
C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
C6 = [-0.4803, -0.082676, 0.0030302]


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def chunk_sums(first: np.ndarray, stop: np.ndarray, n: np.ndarray, most: int = 1 << 20) -> tuple:
    """Sums of the expected normal order statistics m_i, and of their squares, over ranks ``first`` + 1 .. ``stop``.

    At most about ``most`` ranks are in memory at once."""
    one, two, at = np.zeros(len(first)), np.zeros(len(first)), 0
    ends = np.cumsum(stop - first)
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        size = (stop - first)[at:to]
        edge = np.concatenate(([0], np.cumsum(size)))
        rank = np.arange(edge[-1]) - np.repeat(edge[:-1], size) + np.repeat(first[at:to], size) + 1
        m = norm_ppf_array((rank - 0.375) / (np.repeat(n[at:to], size) + 0.25))
        one[at:to] = np.add.reduceat(m, edge[:-1])
        two[at:to] = np.add.reduceat(m * m, edge[:-1])
        at = to
    return one, two


def royston(n: float, dot: float, mm: float, outer: float, inner: float, ss: float) -> tuple:
    """(W, p) from n, sum m_i x_(i), sum m_i^2, x_(n) - x_(1), x_(n-1) - x_(2) and the sum of squared deviations."""
    if n < 12:
        return float("nan"), float("nan")
    if outer <= 0 or ss <= 0:
        return 1.0, 1.0
    last, before = norm_ppf((n - 0.375) / (n + 0.25)), norm_ppf((n - 1.375) / (n + 0.25))
    u = 1.0 / math.sqrt(n)
    an = last / math.sqrt(mm) + _poly(C1, u)
    an1 = before / math.sqrt(mm) + _poly(C2, u)
    phi = (mm - 2 * last ** 2 - 2 * before ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
    weighted = (dot - last * outer - before * inner) / math.sqrt(phi) + an * outer + an1 * inner
    w = min(1.0, weighted ** 2 / ss)
    if w >= 1.0:
        return w, 1.0
    ln = math.log(n)
    z = (math.log(1 - w) - _poly(C5, ln)) / math.exp(_poly(C6, ln))
    return w, float(norm_sf([z])[0])


def shapiro_wilk(x) -> tuple:
    """(W, p) of a sample in memory."""
    x = np.sort(np.asarray(x, dtype=float))
    n = x.size
    if n < 12:
        return float("nan"), float("nan")
    m = norm_ppf_array((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    centred = x - x.mean()
    return royston(n, float(m @ centred), float(m @ m), x[-1] - x[0], x[-2] - x[1], float(centred @ centred))
