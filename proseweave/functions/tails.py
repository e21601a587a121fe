"""Tail functions for small result tables (one value per test, never per data row)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def norm_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def norm_quantile(p: float) -> float:
    return math.inf if p >= 1 else -math.inf if p <= 0 else _NORMAL.inv_cdf(p)


def kendall_two_sided(score: float, variance: float, n: int, ties: bool) -> float:
    """p of Kendall's score: by counting permutations for few rows without ties, else by the normal limit."""
    if not ties and n <= 33:
        fewest = int(round(n * (n - 1) / 2 - abs(score))) // 2  # pairs out of order, or in order if these are fewer
        if 4 * fewest >= n * (n - 1):
            return 1.0
        # permutations of 1..k by their number of pairs out of order
        ways = [1] + [0] * fewest
        for k in range(2, n + 1):
            ways = [sum(ways[max(0, i - k + 1) : i + 1]) for i in range(fewest + 1)]
        return min(1.0, 2 * sum(ways) / math.factorial(n))
    return norm_two_sided(score / math.sqrt(variance)) if variance > 0 else math.nan


def _gamma_ratio(a: float, b: float) -> float:
    """ln gamma(a + b) - ln gamma(a), without the cancellation of two large logarithms."""
    if a < 50:
        return math.lgamma(a + b) - math.lgamma(a)
    rest = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + rest(a + b) - rest(a)


def beta_cdf(x: float, a: float, b: float, y: float | None = None) -> float:
    """Regularised incomplete beta function by its continued fraction. ``y`` is 1 - x where the caller knows it better."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(y, b, a, x)
    large, small = max(a, b), min(a, b)
    log = lambda u, v: math.log1p(-v) if u > 0.5 else math.log(u)
    front = math.exp(_gamma_ratio(large, small) - math.lgamma(small) + a * log(x, y) + b * log(y, x)) / a
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 5000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, dof: float) -> float:
    return beta_cdf(dof / (dof + t * t), dof / 2.0, 0.5, t * t / (dof + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0, d1 * f / (d2 + d1 * f))


def _root(fn, low: float, high: float) -> float:
    """Bisection for a decreasing function."""
    while fn(high) > 0:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if fn(mid) > 0 else (low, mid)
    return (low + high) / 2


def t_quantile(upper: float, dof: float) -> float:
    """Value exceeded with probability ``upper`` (< 0.5)."""
    return _root(lambda t: t_two_sided(t, dof) / 2 - upper, 0.0, 10.0)


def f_quantile(upper: float, d1: float, d2: float) -> float:
    return _root(lambda f: f_tail(f, d1, d2) - upper, 0.0, 10.0)


def power_two_groups(n1: int, n2: int, d: float, alpha: float) -> float:
    """Power of the two-sided two-sample t test: noncentral t by quadrature over the pooled deviation."""
    dof = n1 + n2 - 2
    if dof < 1 or not math.isfinite(d):
        return math.nan
    shift, crit = d / math.sqrt(1 / n1 + 1 / n2), t_quantile(alpha / 2, dof)
    width = 12.0 / math.sqrt(2.0 * dof)
    s = np.linspace(max(1e-9, 1 - width), 1 + width, 4001)
    logs = (dof - 1) * np.log(s) - dof * s * s / 2
    w = np.exp(logs - logs.max())
    w /= w.sum()
    phi = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in shift - crit * s])
    phi2 = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in -shift - crit * s])
    return float(((phi + phi2) * w).sum())


def power_correlation(r: float, n: int, alpha: float = 0.05) -> float:
    if n <= 4 or not math.isfinite(r) or abs(r) >= 1:
        return math.nan
    r = abs(r)
    t = t_quantile(alpha / 2, n - 2)
    rc = math.sqrt(t * t / (t * t + n - 2))
    zr, zc = math.atanh(r) + r / (2 * (n - 1)), math.atanh(rc)
    return _NORMAL.cdf((zr - zc) * math.sqrt(n - 3)) + _NORMAL.cdf((-zr - zc) * math.sqrt(n - 3))


def power_groups(eta2: float, k: int, n: int, alpha: float = 0.05) -> float:
    """Power of a one-way ANOVA with ``n`` rows in each of ``k`` groups (noncentral F as a Poisson mixture)."""
    if not 0 <= eta2 < 1:
        return math.nan
    d1, d2 = k - 1, k * n - k
    half = n * k * eta2 / (1 - eta2) / 2
    crit = f_quantile(alpha, d1, d2)
    x = d1 * crit / (d1 * crit + d2)
    spread = 10 * math.sqrt(half) + 30
    if half > 1e5:
        return 1.0
    total = 0.0
    for j in range(max(0, int(half - spread)), int(half + spread) + 1):
        weight = math.exp(-half + j * math.log(half) - math.lgamma(j + 1)) if half > 0 else float(j == 0)
        total += weight * (1.0 - beta_cdf(x, d1 / 2 + j, d2 / 2))
    return min(1.0, total)


def bayes_factor_correlation(r: float, n: int) -> float:
    """Evidence for a correlation under a uniform prior on it (exact Jeffreys form)."""
    if n < 3 or abs(r) >= 1:
        return math.inf if abs(r) >= 1 else math.nan
    # 2F1((n-1)/2, (n-1)/2; (n+2)/2; r^2) through the Euler transform, whose series is short
    c, term, total = (n + 2) / 2, 1.0, 1.0
    for k in range(20000):
        term *= (1.5 + k) ** 2 / (c + k) / (k + 1) * r * r
        total += term
        if term < 1e-16 * total:
            break
    log = -math.log(2) + 0.5 * math.log(math.pi) + math.lgamma((n + 1) / 2) - math.lgamma((n + 2) / 2)
    log += (4 - n) / 2 * math.log1p(-r * r) + math.log(total)
    return math.exp(log) if log < 700 else math.inf


def bayes_factor_t(t: float, n1: int, n2: int, scale: float = 0.707) -> float:
    """Evidence for a group difference under a Cauchy prior on the effect."""
    dof, eff = n1 + n2 - 2, n1 * n2 / (n1 + n2)
    u = np.linspace(-12, 25, 6001)  # g = exp(u)
    g = np.exp(u)
    a = 1 + eff * g * scale**2
    logs = -0.5 * np.log(a) - (dof + 1) / 2 * np.log1p(t * t / (a * dof)) - 0.5 * u - 1 / (2 * g) - 0.5 * math.log(2 * math.pi)
    base = -(dof + 1) / 2 * math.log1p(t * t / dof)
    top = logs.max()
    log = top + math.log(np.exp(logs - top).sum() * (u[1] - u[0])) - base
    return math.exp(log) if log < 700 else math.inf


def fisher_interval(r: float, n: int, z: float) -> tuple[float, float]:
    if n <= 3 or abs(r) >= 1:
        return r, r
    mid, half = math.atanh(r), z / math.sqrt(n - 3)
    return math.tanh(mid - half), math.tanh(mid + half)


def agreement_interval(msr: float, msc: float, mse: float, n: int, k: int, alpha: float = 0.05) -> tuple[float, float]:
    """Confidence interval of the two-way random single-measure agreement."""
    icc = (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)
    fj = msc / mse
    share = k * icc * fj + n * (1 + (k - 1) * icc) - k * icc
    v = (k - 1) * (n - 1) * share**2 / ((n - 1) * k * k * icc * icc * fj * fj + (n * (1 + (k - 1) * icc) - k * icc) ** 2)
    up, low = f_quantile(alpha / 2, n - 1, v), f_quantile(alpha / 2, v, n - 1)
    rest = k * msc + (k * n - k - n) * mse
    return n * (msr - up * mse) / (up * rest + n * msr), n * (low * msr - mse) / (rest + n * low * msr)
