"""Small numpy kernels for what built-in functions can't express: Huber regression, KDE quantiles, Mann-Kendall's p."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.settings import EPS, Settings

LABELS = ("robust_regression", "boxplot", "n_sigma", "trend")
#: Values that a detector needs, and those of the trend.
LEAST, LEAST_TREND = 8, 6
#: |z| of a two-sided normal test at 5 %.
NORMAL_5 = 1.959963984540054


def _middle(x: np.ndarray) -> np.ndarray:
    """Median of each row; faster than numpy's for rows of some tens of values."""
    n = x.shape[1]
    x = np.sort(x, axis=1)
    return (x[:, (n - 1) // 2] + x[:, n // 2]) / 2


def huber_lines(y: np.ndarray, alpha: float = 1e-4, epsilon: float = 1.35, rounds: int = 50, ahead: int = 1) -> np.ndarray:
    """Robust linear trends of the rows of a matrix by reweighted ridge equations: forecast, deviation of residuals, intercept, slope.

    All rows go through a round together, and rows that have settled leave.
    """
    n = y.shape[1]
    x = np.arange(1.0, n + 1)
    x2 = x * x

    def solve(w: np.ndarray, y: np.ndarray) -> np.ndarray:
        # Two equations in closed form; the ridge is on both coefficients.
        a, b, c = w.sum(axis=1) + alpha, w @ x, w @ x2 + alpha
        p, q = (w * y).sum(axis=1), (w * y) @ x
        return np.stack([c * p - b * q, a * q - b * p], axis=1) / (a * c - b * b)[:, None]

    line = solve(np.ones_like(y), y)
    open_ = np.arange(len(y))
    for _ in range(rounds):
        now, own = line[open_], y[open_]
        off = own - now[:, :1] - now[:, 1:] * x
        size = np.abs(off)
        spread = np.sqrt(np.maximum(np.einsum("ij,ij->i", off, off) / n - off.mean(axis=1) ** 2, 0.0))
        limit = epsilon * np.maximum(np.maximum(1.4826 * _middle(np.abs(off - _middle(off)[:, None])), spread), EPS)[:, None]
        found = solve(np.where(size > limit, limit / np.maximum(size, 1e-300), 1.0), own)
        line[open_] = found
        moved = (np.abs(found - now) > 1e-6 + 1e-5 * np.abs(now)).any(axis=1)
        open_ = open_[moved]
        if not len(open_):
            break
    off = y - line[:, :1] - line[:, 1:] * x
    return np.stack([line[:, 0] + line[:, 1] * (n + ahead), np.maximum(off.std(axis=1), EPS), line[:, 0], line[:, 1]], axis=1)


def joint_lines(y: np.ndarray, alpha: float = 1e-4, epsilon: float = 1.35, rounds: int = 500, ahead: int = 1) -> np.ndarray:
    """Robust linear trends of the rows of a matrix, with their scale: forecast, deviation of residuals, intercept, slope (over standardised places).

    Minimises the sum of s + s h(r / s) over residuals r, plus alpha slope^2, over line and scale s together, where
    h is Huber's loss; it is convex in both. Given the line the least scale is one of n candidates, by how many
    residuals lie within epsilon s; given the scale, a reweighted line never raises the sum.
    """
    n = y.shape[1]
    place = np.arange(1.0, n + 1)
    mean, sd = place.mean(), max(float(place.std()), 1.0)
    x = (place - mean) / sd
    inside = np.arange(1, n + 1)
    free = n - epsilon**2 * (n - inside)
    line, scale = np.stack([y.mean(axis=1), np.zeros(len(y))], axis=1), np.ones(len(y))
    open_ = np.arange(len(y))
    for _ in range(rounds):
        now, own = line[open_], y[open_]
        size = np.abs(own - now[:, :1] - now[:, 1:] * x)
        ordered = np.sort(size, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            tried = np.sqrt(np.where(free > 0, np.cumsum(ordered**2, axis=1) / free, np.inf))
        fits = (ordered <= epsilon * tried) & (epsilon * tried < np.c_[ordered[:, 1:], np.full(len(own), np.inf)]) & (free > 0)
        s = np.where(fits.any(axis=1), tried[np.arange(len(own)), fits.argmax(axis=1)], 0.0)
        s = np.maximum(s, 1e-10)
        w = np.where(size > epsilon * s[:, None], epsilon * s[:, None] / np.maximum(size, 1e-300), 1.0)
        a, b, c = w.sum(axis=1), w @ x, w @ (x * x) + alpha * s
        p, q = (w * own).sum(axis=1), (w * own) @ x
        found = np.stack([c * p - b * q, a * q - b * p], axis=1) / (a * c - b * b)[:, None]
        moved = np.abs(found - now).max(axis=1) + np.abs(s - scale[open_]) > 1e-9 * (1 + np.abs(now).max(axis=1))
        line[open_], scale[open_] = found, s
        open_ = open_[moved]
        if not len(open_):
            break
    off = y - line[:, :1] - line[:, 1:] * x
    return np.stack([line[:, 0] + line[:, 1] * (n + ahead - mean) / sd, np.maximum(off.std(axis=1), EPS), line[:, 0], line[:, 1]], axis=1)


def huber_forecast(values, alpha: float = 1e-4, epsilon: float = 1.35, rounds: int = 50, ahead: int = 1, joint: bool = False) -> tuple[float, float, float, float]:
    """huber_lines, or joint_lines, of one series of any length; values that aren't finite are left out."""
    y = np.asarray(values, float)
    y = y[np.isfinite(y)]
    if len(y) < 2:
        last = float(y[-1]) if len(y) else 0.0
        return last, 0.0, last, 0.0
    found = joint_lines(y[None], alpha, epsilon, ahead=ahead) if joint else huber_lines(y[None], alpha, epsilon, rounds, ahead)
    return tuple(found[0].tolist())


def _density(x: np.ndarray, grid: np.ndarray, width: float) -> np.ndarray:
    """Sum of Gaussian kernels of x at each point of an even grid, up to a factor.

    Each x is moved to its nearest grid point and the kernel there expanded in the distance, which
    makes a few convolutions of the grid, as exact as doubles are, of the sum over all pairs.
    """
    step = (grid[1] - grid[0]) / width
    most = 8.6 * step / 2  # the largest product of distances that counts: exp(-8.6 ** 2 / 2) is below rounding
    if len(x) < 400 or most > 6:
        return np.exp(-0.5 * ((grid[None] - x[:, None]) / width) ** 2).sum(axis=0)
    place = (x - grid[0]) / width / step
    at = np.rint(place).astype(np.int64)
    off, n = (place - at) * step, len(grid)
    wide = min(int(10 / step) + 1, n - 1)  # farther kernels are below rounding
    apart = step * np.arange(-wide, wide + 1)
    weight, kernel, out, term, size = np.exp(-0.5 * off * off), np.exp(-0.5 * apart * apart), np.zeros(n), 0, 1.0
    while size > 1e-17:
        out += np.convolve(np.bincount(at, weights=weight, minlength=n), kernel)[wide : wide + n]
        term += 1
        size *= most / term
        weight, kernel = weight * off / term, kernel * apart
    return out


def kde_bounds(values, low: float = 0.025, high: float = 0.975, by_covariance: bool = False) -> tuple[float, float]:
    """Quantiles of a Gaussian kernel density on a grid; plain quantiles below 20 values, (-3, 3) without any.

    by_covariance: kernels scaled by the sample deviation times n^(-1/5), on 1,024 points that reach three
    deviations beyond the values, for values that aren't all the same.
    """
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    if not len(x):
        return -3.0, 3.0
    if len(x) < 20:
        return float(np.quantile(x, low)), float(np.quantile(x, high))
    if by_covariance and x.std() > 0:
        width, far, points = float(x.std(ddof=1)) * len(x) ** -0.2, float(x.std()), 1024
    else:
        width = far = max(1.06 * float(x.std()) * len(x) ** -0.2, 0.1)
        points = 512
    grid = np.linspace(x.min() - 3 * far, x.max() + 3 * far, points)
    share = np.cumsum(_density(x, grid, width))
    share /= max(float(share[-1]), EPS)
    return float(np.interp(low, share, grid)), float(np.interp(high, share, grid))


def mann_kendall(values) -> tuple[bool, float]:
    """(significant at 5 %, two-sided p)."""
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 5:
        return False, 1.0
    s = sum(np.sign(x[i + 1 :] - x[i]).sum() for i in range(n - 1))
    z = (s - np.sign(s)) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    p = math.erfc(abs(z) / math.sqrt(2))
    return p < 0.05, p


def mann_kendall_scores(values: np.ndarray) -> np.ndarray:
    """z of each row of a matrix, with continuity correction, without ties' correction; 0 below five values."""
    n = values.shape[1]
    if n < 5:
        return np.zeros(len(values))
    early, late = np.triu_indices(n, 1)
    s = np.sign(values[:, late] - values[:, early]).sum(axis=1)
    return (s - np.sign(s)) / math.sqrt(n * (n - 1) * (2 * n + 5) / 18)


def local_flags(past: np.ndarray, x: np.ndarray, settings: Settings) -> np.ndarray:
    """LABELS of values x after the rows of past, the latest values last."""
    tail = lambda n: past[:, -n:]
    far = lambda off, sd, times, least: np.abs(off) >= np.maximum(times * sd, least)
    none, out = np.zeros(len(x), bool), []
    line = tail(settings.local_regression_window)
    if line.shape[1] >= LEAST:
        fit = joint_lines(line) if settings.line_rule == "joint" else huber_lines(line)
        out.append(np.abs(x - fit[:, 0]) > np.maximum(3 * fit[:, 1], 0.01))
    else:
        out.append(none)
    box = tail(settings.local_boxplot_window)
    if box.shape[1] >= LEAST:
        low, middle, high = np.quantile(box, (0.25, 0.5, 0.75), axis=1)
        wide = 1.5 * (high - low)
        out.append(far(x - middle, box.std(axis=1), 2, 0.005) & ((x < low - wide) | (x > high + wide)))
    else:
        out.append(none)
    near = tail(settings.local_nsigma_window)
    off, sd = x - near.mean(axis=1), near.std(axis=1)
    out.append((sd > 0) & far(off, sd, 2, 0.005) & (np.abs(off) > 3 * sd) if near.shape[1] >= LEAST else none)
    run = tail(settings.local_trend_window)
    if run.shape[1] >= LEAST_TREND:
        z = mann_kendall_scores(np.diff(np.c_[run, x], axis=1))
        out.append((np.abs(z) > NORMAL_5) & (np.abs(x - run.mean(axis=1)) > np.maximum(2 * run.std(axis=1), 0.005)))
    else:
        out.append(none)
    return np.stack(out, axis=1)


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def _fitted(values: pd.Series, lines) -> pd.DataFrame:
    """Series of one length are fitted together."""
    out = np.full((len(values), 4), np.nan)
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    for n, v in enumerate(values):
        if v is None:
            continue
        y = np.asarray(v, float)
        y = y[np.isfinite(y)]
        if len(y) < 2:
            out[n] = huber_forecast(y)
        else:
            by_length.setdefault(len(y), []).append((n, y))
    for own in by_length.values():
        out[[n for n, _ in own]] = lines(np.stack([y for _, y in own]))
    return pd.DataFrame(out, columns=["forecast", "deviation", "intercept", "slope"])


@F.pandas_udf(_doubles("forecast", "deviation", "intercept", "slope"))
def huber_of(values: pd.Series) -> pd.DataFrame:
    return _fitted(values, huber_lines)


@F.pandas_udf(_doubles("lower", "upper"))
def kde_of(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kde_bounds(v) for v in values], columns=["lower", "upper"])


@F.pandas_udf(_doubles("lower", "upper"))
def covariance_kde_of(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kde_bounds(v, by_covariance=True) for v in values], columns=["lower", "upper"])


@F.pandas_udf(T.DoubleType())
def mann_kendall_p(values: pd.Series) -> pd.Series:
    return values.map(lambda v: mann_kendall(v)[1])
