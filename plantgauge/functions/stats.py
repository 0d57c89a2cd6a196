"""Distribution functions and tail fits on NumPy alone."""

from __future__ import annotations

import math

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_quantile(p: float, dof: float) -> float:
    """The value below which a chi-squared variable lies with probability p, by bisection."""
    low, high = 0.0, max(dof, 1.0)
    while gamma_p(dof / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(dof / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, dof: float) -> float:
    """Probability of a Student t at least as far from 0."""
    return beta_i(dof / 2, 0.5, dof / (dof + t * t)) if dof > 0 else float("nan")


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    if n == 0 or m == 0:
        return float("nan")
    x = math.sqrt(n * m / (n + m)) * statistic
    if x < 1e-3:
        return 1.0
    if x < 0.6:  # the other theta series converges fast here
        return 1 - math.sqrt(2 * math.pi) / x * sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 20))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def gpd_fit(excess: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """(shape, scale) of a generalised Pareto distribution by maximum likelihood; `counts` says how often each excess
    occurs.

    The profile likelihood in theta = shape / scale has one unknown; it is searched on a grid and then refined.
    """
    x = np.asarray(excess, float)
    weight = np.ones(len(x)) if counts is None else np.asarray(counts, float)
    x, weight = x[x > 0], weight[x > 0]
    n = weight.sum()
    top, mean = x.max(), float(x @ weight / n)

    def profile(theta: float) -> tuple[float, float]:
        inside = 1 + theta * x
        if (inside <= 0).any():
            return -np.inf, 0.0
        if abs(theta) < 1e-12:
            return -n * (math.log(mean) + 1), 0.0
        shape = float(np.log(inside) @ weight / n)
        if shape / theta <= 0 or shape <= -1:
            return -np.inf, shape
        return -n * (math.log(shape / theta) + shape + 1), shape

    grid = np.concatenate((-(1 - np.geomspace(1e-4, 0.999, 80)) / top, [0.0], np.geomspace(1e-4, 1e3, 160) / mean))
    grid.sort()
    best = int(np.argmax([profile(t)[0] for t in grid]))
    low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if profile(a)[0] > profile(b)[0] else (a, high)
    theta = (low + high) / 2
    _, shape = profile(theta)
    return (0.0, float(mean)) if abs(theta) < 1e-12 or shape == 0 else (shape, shape / theta)


def gpd_limit(threshold: float, shape: float, scale: float, exceeding: float, p: float) -> float:
    """The p-quantile of scores of which the share `exceeding` lies above `threshold` with that tail."""
    rest = (1 - p) / exceeding
    return threshold - scale * math.log(rest) if abs(shape) < 1e-6 else threshold + scale / shape * (rest**-shape - 1)
