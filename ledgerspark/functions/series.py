"""Decomposition and tests of one short series (months): numpy arrays in, numbers out."""

from __future__ import annotations

import math

import numpy as np

from . import dist


def loess(y: np.ndarray, window: int, degree: int, at: np.ndarray, robust: np.ndarray | None = None) -> np.ndarray:
    """Tricube-weighted local fits of degree 0 or 1 to equally spaced y, evaluated at positions `at`."""
    x, n = np.arange(len(y), dtype=float), len(y)
    far = np.abs(at[:, None] - x)
    reach = np.sort(far, axis=1)[:, min(window, n) - 1] * max(1.0, window / n)
    reach = np.maximum(reach, 1e-9)[:, None]
    plain = np.clip(1 - (far / reach) ** 3, 0, None) ** 3
    plain[plain.sum(axis=1) == 0] = 1.0
    w = plain if robust is None else plain * robust
    w = np.where(w.sum(axis=1, keepdims=True) > 1e-12, w, plain)
    w = w / w.sum(axis=1, keepdims=True)
    fit = w @ y
    if degree:
        middle = w @ x
        off = x - middle[:, None]
        spread = (w * off * off).sum(axis=1)
        slope = np.divide((w * off) @ y, spread, out=np.zeros_like(fit), where=spread > 1e-9)
        fit = fit + (at - middle) * slope
    return fit


def stl(y: np.ndarray, period: int = 12, seasonal: int = 13, trend: int = 25, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal part and remainder by the robust procedure of Cleveland et al. (1990); seasonal degree 0."""
    n, low = len(y), period + 1 - period % 2
    here, moving = np.arange(n, dtype=float), lambda v, k: np.convolve(v, np.full(k, 1 / k), "valid")
    level, robust = np.zeros(n), np.ones(n)
    for _ in range(outer + 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * period)
            for j in range(period):
                own = (y - level)[j::period]
                cycle[j::period] = loess(own, seasonal, 0, np.arange(-1.0, len(own) + 1), robust[j::period])
            smooth = loess(moving(moving(moving(cycle, period), period), 3), low, 1, here)
            season = cycle[period : period + n] - smooth
            level = loess(y - season, trend, 1, here, robust)
        rest = y - level - season
        scale = 6 * np.median(np.abs(rest))
        robust = np.clip(1 - (rest / scale) ** 2, 0, None) ** 2 if scale > 1e-12 else np.ones(n)
    return level, season, rest


def residual_scale(rest: np.ndarray) -> float:
    """1.4826 times the median absolute deviation, or the standard deviation where that is next to nothing."""
    scale = 1.4826 * float(np.median(np.abs(rest - np.median(rest))))
    return scale if scale >= 1e-4 else float(rest.std(ddof=1))


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their errors and the residual sum of squares."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ (x.T @ y)
    ssr = float(((y - x @ beta) ** 2).sum())
    return beta, np.sqrt(np.clip(np.diag(inverse) * ssr / max(1, len(y) - x.shape[1]), 0, None)), ssr


# MacKinnon's (1994) response surface for one series with a constant, and the KPSS table with a trend.
ADF_SMALL, ADF_LARGE, ADF_TURN, ADF_RANGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61, (-18.83, 2.74)
KPSS_TABLE = ((0.119, 0.10), (0.146, 0.05), (0.176, 0.025), (0.216, 0.01))


def adf(y: np.ndarray) -> tuple[float, float, int] | None:
    """Statistic, p-value and lags (least AIC) of the augmented Dickey-Fuller test with a constant; None for a constant series."""
    n, dy = len(y), np.diff(y)
    most = max(0, min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25)))

    def system(lags: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        columns = [y[first:-1], *(dy[first - i : len(dy) - i] for i in range(1, lags + 1)), np.ones(len(dy) - first)]
        return np.column_stack(columns), dy[first:]

    if np.ptp(y) < 1e-12:
        return None

    def aic(lags: int) -> float:
        x, target = system(lags, most)
        return len(target) * math.log(max(ols(x, target)[2], 1e-300) / len(target)) + 2 * x.shape[1]

    lags = min(range(most + 1), key=aic)
    beta, error, _ = ols(*system(lags, lags))
    if error[0] < 1e-15:
        return None
    t = float(beta[0] / error[0])
    if not ADF_RANGE[0] < t < ADF_RANGE[1]:
        return t, float(t >= ADF_RANGE[1]), lags
    terms = ADF_SMALL if t <= ADF_TURN else ADF_LARGE
    return t, dist.normal_sf(-sum(c * t**i for i, c in enumerate(terms))), lags


def kpss(y: np.ndarray) -> tuple[float, float, int] | None:
    """Statistic, p-value (0.01 to 0.10, between the table's entries) and lags of the KPSS test around a trend."""
    n = len(y)
    x = np.column_stack([np.ones(n), np.arange(n)])
    e = y - x @ ols(x, y)[0]
    if e @ e < 1e-18 * max(1.0, float(y @ y)):
        return None
    products = [2 * float(e[i:] @ e[: n - i]) / n for i in range(1, int(n ** (2 / 9)) + 1)]
    s0, s1 = float(e @ e) / n + sum(products), sum(i * v for i, v in enumerate(products, 1))
    lags = min(n - 1, int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)))
    long_run = (float(e @ e) + 2 * sum((1 - i / (lags + 1)) * float(e[i:] @ e[: n - i]) for i in range(1, lags + 1))) / n
    statistic = float((np.cumsum(e) ** 2).sum()) / n**2 / long_run
    return statistic, float(np.interp(statistic, *zip(*KPSS_TABLE, strict=True))), lags


def acf(y: np.ndarray, lags: int) -> np.ndarray:
    d = y - y.mean()
    return np.array([float(d[k:] @ d[: len(d) - k]) for k in range(lags + 1)]) / float(d @ d)


def pacf(y: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelations from the Yule-Walker equations with sums divided by their number of terms."""
    n = len(y)
    r = acf(y, lags) * n / (n - np.arange(lags + 1))
    solve = lambda k: np.linalg.lstsq(r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))], r[1 : k + 1], rcond=None)[0][-1]
    return np.array([1.0, *(solve(k) for k in range(1, lags + 1))])


def ljung_box(y: np.ndarray, lags: int) -> tuple[float, float, int]:
    n, r = len(y), acf(y, lags)[1:]
    q = float(n * (n + 2) * (r * r / (n - np.arange(1, lags + 1))).sum())
    return q, dist.chi_square_sf(q, lags), lags
