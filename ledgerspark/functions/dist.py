"""Distribution functions and tests over sufficient statistics: plain numbers in, plain numbers out.

Spark reduces the data to a few moments, counts or rank sums (see plans/analytics.py); what is here turns those single
rows into p-values and intervals. Incomplete beta and gamma functions by continued fractions and series.
"""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d or tiny)
            c = 1 + up / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * total:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = f = 1 / b
    for i in range(1, 1000):
        an, b = -i * (i - a), b + 2
        d = 1 / (an * d + b)
        c = b + an / c
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi_square_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def t_quantile(p: float, df: float) -> float:
    """The two-sided critical value: the t beyond which, on both sides, lies 1 - p."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(range of k group means > q) in units of their estimated deviation, by quadrature; all but exact from df 1e5 on."""
    if q <= 0:
        return 1.0
    phi = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
    z = np.linspace(-8, 8, 401)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def within(w: float) -> float:
        return float(k * np.trapezoid(density * (phi(z) - phi(z - w)) ** (k - 1), z))

    if df >= 1e5:
        return min(1.0, max(0.0, 1 - within(q)))
    half = 8 / math.sqrt(2 * df)
    s = np.linspace(max(1e-6, 1 - half), 1 + half, 161)
    log = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return min(1.0, max(0.0, 1 - float(np.trapezoid(np.exp(log) * np.array([within(q * x) for x in s]), s))))


def t_interval(n: int, mean: float, var: float, level: float = 0.95) -> tuple[float, float]:
    half = t_quantile(level, n - 1) * math.sqrt(var / n)
    return mean - half, mean + half


def wilson(k: int, n: int, z: float = 1.959963984540054) -> tuple[float, float]:
    p, w = k / n, z * z / n
    half = z * math.sqrt(p * (1 - p) / n + w / (4 * n)) / (1 + w)
    return max(0.0, (p + w / 2) / (1 + w) - half), min(1.0, (p + w / 2) / (1 + w) + half)


def welch(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[float, float, float]:
    """t, degrees of freedom and two-sided p of two groups (n, mean, variance)."""
    va, vb = a[2] / a[0], b[2] / b[0]
    t = (a[1] - b[1]) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va * va / (a[0] - 1) + vb * vb / (b[0] - 1))
    return t, df, t_two_sided(t, df)


def cohen_d(a: tuple[int, float, float], b: tuple[int, float, float]) -> float:
    return (a[1] - b[1]) / math.sqrt(((a[0] - 1) * a[2] + (b[0] - 1) * b[2]) / (a[0] + b[0] - 2))


def anova(groups: list[tuple[int, float, float]]) -> tuple[float, float, float]:
    """F, p and eta squared of groups (n, mean, variance)."""
    n, k = sum(g[0] for g in groups), len(groups)
    grand = sum(g[0] * g[1] for g in groups) / n
    between, within = sum(g[0] * (g[1] - grand) ** 2 for g in groups), sum((g[0] - 1) * g[2] for g in groups)
    f = (between / (k - 1)) / (within / (n - k))
    return f, f_sf(f, k - 1, n - k), between / (between + within)


def mann_whitney(n1: int, rank_sum: float, n2: int, ties: float = 0.0) -> tuple[float, float, float]:
    """U of the first group, two-sided p (normal, tie- and continuity-corrected), rank-biserial effect."""
    u, n = rank_sum - n1 * (n1 + 1) / 2, n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (abs(u - n1 * n2 / 2) - 0.5) / sd
    return u, min(1.0, 2 * normal_sf(z)), 1 - 2 * u / (n1 * n2)


def kruskal(groups: list[tuple[int, float]], ties: float = 0.0) -> tuple[float, float]:
    """H (tie-corrected) and p of groups (n, rank sum)."""
    n = sum(g[0] for g in groups)
    h = (12 / (n * (n + 1)) * sum(r * r / m for m, r in groups) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return h, chi_square_sf(h, len(groups) - 1)


def cramers_v(chi_square: float, n: int, rows: int, columns: int) -> float:
    return math.sqrt(chi_square / n / max(min(rows - 1, columns - 1), 1))


def correlation_p(r: float, n: int) -> float:
    return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


#: Where effects start to count as small, medium and large, by kind of effect.
EDGES = {"d": (0.2, 0.5, 0.8), "r": (0.1, 0.3, 0.5), "v": (0.1, 0.3, 0.5), "eta": (0.01, 0.06, 0.14)}


def magnitude(kind: str, effect: float) -> str:
    return ("negligible", "small", "medium", "large")[sum(abs(effect) >= e for e in EDGES[kind])]


def strength(r: float) -> str:
    """The words for a correlation."""
    word = ("negligible", "weak", "moderate", "strong", "very strong")[sum(abs(r) >= e for e in (0.1, 0.3, 0.5, 0.7))]
    return word if word == "negligible" else f"{word} {'positive' if r > 0 else 'negative'}"
