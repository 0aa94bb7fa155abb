"""P-values of finished test statistics.

These close a distributed computation: one scalar call per compared column.
"""

from __future__ import annotations

import math

import numpy as np


# Up to this many rows on the larger side the exact distribution is used.
EXACT_ROWS = 10_000


def kolmogorov_p(statistic: float, n_ref: int, n_new: int) -> float:
    """Two-sample Kolmogorov-Smirnov p-value: exact up to EXACT_ROWS rows on either side, else asymptotic."""
    if max(n_ref, n_new) <= EXACT_ROWS:
        return kolmogorov_exact(statistic, n_ref, n_new)
    return kolmogorov_series(statistic, n_ref, n_new)


def kolmogorov_exact(statistic: float, n_ref: int, n_new: int) -> float:
    """Share of the lattice paths from (0, 0) to (n_ref, n_new) that reach a gap of *statistic* or more.

    Each path is an order in which the rows of both samples may come, all as likely; at (i, j) its gap is
    i / n_ref - j / n_new. The share of paths that have reached it follows from the two places a step back, one
    antidiagonal at a time. All terms are positive, so small p-values keep their digits. Rows that tie count as
    if in any order.
    """
    reach = round(statistic * n_ref * n_new)  # gaps are whole multiples of 1 / (n_ref * n_new)
    if reach <= 0:
        return 1.0
    i = np.arange(n_ref + 1)
    share = np.zeros(n_ref + 1)
    for k in range(1, n_ref + n_new + 1):
        j = k - i
        share[1:] = (i[1:] * share[:-1] + j[1:] * share[1:]) / k
        share[0] = share[0] * j[0] / k
        valid = (j >= 0) & (j <= n_new)
        share[(np.abs(i * n_new - j * n_ref) >= reach) & valid] = 1.0
        share[~valid] = 0.0
    return float(min(share[n_ref], 1.0))


def kolmogorov_series(statistic: float, n_ref: int, n_new: int) -> float:
    """Asymptotic p-value."""
    lam = statistic * math.sqrt(n_ref * n_new / (n_ref + n_new))
    if lam < 0.05:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam) for k in range(1, 101))
    return min(max(2.0 * total, 0.0), 1.0)


def chi2_p(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution: Q(dof / 2, statistic / 2)."""
    a, x = dof / 2.0, statistic / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(max(1.0 - total * front, 0.0), 1.0)
    tiny = 1e-300
    b = x + 1 - a
    cc, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (tiny if abs(d) < tiny else d)
        cc = b + an / cc
        cc = tiny if abs(cc) < tiny else cc
        delta = d * cc
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return min(max(front * h, 0.0), 1.0)
