"""The part of the plan that reads its own results: predictions, their correction, and learned bounds.

A prediction enters the residuals and corrections of later ones, abnormal minutes are replaced by
their predictions, and bounds are learned from normal points; so each metric's rows are folded in
order. What doesn't feed back (baselines, local detectors, periodicity, confidence) is left to
window expressions around the fold.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewatch.functions.kernels import huber_forecast, huber_lines, joint_lines, kde_bounds
from tidewatch.operators.features import ROLLING, Tail
from tidewatch.operators.folds import Carry, fold_by_key
from tidewatch.settings import DEFAULTS, EPS, MAX_Z_HISTORY, RECENT_LIMIT, Settings

ADDED = (
    "predict_value double, predict_lower double, predict_upper double, model_name string, baseDayDiff double, rolling_mean_7d double, rolling_std_7d double, "
    "rolling_p70_7d double, rolling_p30_7d double, z_score double, lower_bound double, upper_bound double, segment string, direction string, global_abnormal boolean"
)

NAMES = [x.split()[0] for x in ADDED.split(", ")]


@dataclass
class Bounds:
    z: list = field(default_factory=list)
    now: tuple | None = None
    dirty: int = 0
    at: int = 0


#: Values that a minute's line is fitted to, and how many minutes are fitted at once at most.
LINE, AHEAD = 60, 512


class Ahead:
    """Lines of the minutes to come, fitted many at once, for as long as those minutes turn out as assumed.

    A minute's line reads the values before it, and of flagged ones their predictions. Local flags are known
    beforehand; so flagged minutes are fitted one by one, the others all together, on the assumption that no other
    minute will be flagged. One that is ends what was fitted, and fitting goes on from the next, over about as many
    minutes as were of use, and over twice as many once all were.
    """

    def __init__(self, values: np.ndarray, flags: np.ndarray, settings: Settings):
        self.values, self.flags, self.settings, self.at, self.begin, self.fits, self.size = values, flags, settings, 0, 0, [], 1

    def fit(self, clean: list) -> tuple[float, float]:
        """Forecast and deviation of the next minute; clean: the values before it."""
        if self.at >= self.begin + len(self.fits):
            self._look_ahead(clean)
        return self.fits[self.at - self.begin]

    def _look_ahead(self, clean: list) -> None:
        joint = self.settings.line_rule == "joint"
        lines = lambda y: joint_lines(y) if joint else huber_lines(y, rounds=200)
        stop = min(self.at + self.size, len(self.values))
        y, known = np.concatenate([clean, self.values[self.at : stop]]), {}
        for n in np.flatnonzero(self.flags[self.at : stop]).tolist():
            forecast, sd, _, _ = lines(y[None, n : n + LINE])[0].tolist()
            known[n] = forecast, sd
            y[n + LINE] = max(forecast, EPS)
        rest = [n for n in range(stop - self.at) if n not in known]
        if rest:
            known.update(zip(rest, map(tuple, lines(np.lib.stride_tricks.sliding_window_view(y, LINE)[rest])[:, :2].tolist()), strict=True))
        self.begin, self.fits, self.size = self.at, [known[n] for n in range(stop - self.at)], min(2 * self.size, AHEAD)

    def took(self, flag: bool) -> None:
        if flag != bool(self.flags[self.at]):
            self.fits = self.fits[: self.at + 1 - self.begin]
            self.size = max(1, len(self.fits))
        self.at += 1


@dataclass
class State:
    correction: float = 1.0
    second_sd: float = 0.01
    minute_sd: float = 0.05
    up: int = 0
    down: int = 0
    bounds: dict = field(default_factory=lambda: {s: Bounds() for s in ("peak", "valley", "mid")})
    series: dict = field(default_factory=dict)
    ahead: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ahead": {}}

    def of(self, label: str, settings: Settings) -> tuple[Tail, deque]:
        """The tail of values, and (actual, predicted, flag) of the last points, of one granularity."""
        if label not in self.series:
            self.series[label] = (Tail.of(label, settings), deque(maxlen=RECENT_LIMIT))
        return self.series[label]


def predict_second(s: State, x: float, base: float, day_diff: float, factor: float) -> tuple[float, float, float]:
    pre = max(base + day_diff, 0.5 * base, EPS)
    p = max(pre * s.correction * factor, EPS)
    low, high = max(p - 2 * s.second_sd, 0.0), p + 2 * s.second_sd
    s.correction = min(max(0.9 * s.correction + 0.1 * x / max(pre * factor, EPS), 0.5), 1.5)
    s.second_sd = max(0.9 * s.second_sd + 0.1 * abs(x - p), 0.001)
    return p, low, high


def predict_minute(s: State, x: float, tail: deque, settings: Settings = DEFAULTS, ahead: Ahead | None = None) -> tuple[float, float, float]:
    clean = [p if flag else a for a, p, flag in list(tail)[-LINE:]]
    if len(clean) < 5:
        p = sum(clean) / len(clean) if clean else x
        sd = (sum((c - p) ** 2 for c in clean) / len(clean)) ** 0.5 if len(clean) > 1 else (0.0 if clean else s.minute_sd)
    elif ahead is not None and len(clean) == LINE:
        p, sd = ahead.fit(clean)
    else:
        p, sd, _, _ = huber_forecast(clean, rounds=200, joint=settings.line_rule == "joint")
    s.minute_sd = max(0.8 * s.minute_sd + 0.2 * sd, 0.001)
    return max(p, EPS), max(p - 2 * s.minute_sd, 0.0), p + 2 * s.minute_sd


def judge(s: State, now: int, x: float, p: float, p70: float, p30: float, label: str, settings: Settings) -> tuple:
    """z, bounds, segment, direction and whether the run of points outside is long enough; learns from normal points."""
    name = "peak" if p >= p70 else "valley" if p <= p30 else "mid"
    b = s.bounds[name]

    def refresh(z: list) -> None:
        b.now, b.dirty, b.at = kde_bounds(z, settings.global_lower_quantile, settings.global_upper_quantile, settings.density_rule == "covariance"), 0, now

    if b.now is None or now - b.at >= settings.kde_refresh_interval_sec:
        refresh(b.z)
    low, high = min(b.now[0], -0.05), max(b.now[1], 0.05)
    z = (x - p) / max(abs(p) ** 0.5, EPS)
    s.up, s.down = (s.up + 1 if z > high else 0), (s.down + 1 if z < low else 0)
    least = settings.second_consecutive_points if label == "1s" else settings.minute_consecutive_points
    abnormal = max(s.up, s.down) >= least
    if not abnormal:
        b.dirty += 1
        b.z.append(z)
        del b.z[:-MAX_Z_HISTORY]
        if b.dirty >= settings.kde_refresh_every_points:
            refresh(b.z)
    return z, low, high, name, "up" if z > high else "down" if z < low else "normal", abnormal


def predict_row(s: State, row, settings: Settings) -> tuple:
    """The ADDED values of a row (value, timestamp, granularity, mode, base_value, factor, local_score, ROLLING), which the state learns."""
    tail = s.of(row.granularity, settings)[1]
    x, now = row.value, int(row.timestamp)
    mean, sd, p70, p30 = row.rolling_mean_7d, row.rolling_std_7d, row.rolling_p70_7d, row.rolling_p30_7d
    off = sum([a - p for a, p, _ in tail]) / len(tail) if tail else 0.0
    bound = 0.2 * max(abs(mean), abs(x), 1e-3)
    diff = min(max(off, -bound), bound)
    if row.mode == "ai":
        p, low, high = predict_second(s, x, row.base_value, diff, row.factor)
    else:
        p, low, high = predict_minute(s, x, tail, settings, s.ahead.get(row.granularity))
    z, lower, upper, name, way, abnormal = judge(s, now, x, p, p70, p30, row.granularity, settings)
    tail.append((x, p, bool(abnormal or row.local_score > 0)))
    if row.granularity in s.ahead:
        s.ahead[row.granularity].took(tail[-1][2])
    return p, low, high, "seasonal_adjustment" if row.mode == "ai" else "minute_huber", diff, mean, sd, p70, p30, z, lower, upper, name, way, abnormal


def with_rolling(s: State, rows: pd.DataFrame, settings: Settings) -> dict[str, np.ndarray]:
    """ROLLING of rows of a metric, series by series: they read actual values only, so they need no loop."""
    found = np.empty((len(rows), len(ROLLING)))
    labels, times, values = (rows[c].to_numpy() for c in ("granularity", "timestamp", "value"))
    for label in dict.fromkeys(labels):
        own = labels == label
        found[own] = s.of(label, settings)[0].take(times[own], values[own])
        s.ahead.pop(label, None)
        if (rows["mode"].to_numpy()[own] != "ai").all() and np.isfinite(values[own]).all():
            s.ahead[label] = Ahead(values[own].astype(float), rows["local_score"].to_numpy()[own] > 0, settings)
    return dict(zip(ROLLING, found.T, strict=True))


def predict_and_judge(series: DataFrame, settings: Settings = DEFAULTS, carry: Carry | None = None) -> DataFrame:
    """series: metric_name, timestamp, granularity, value, mode, base_value, factor, local_score; rows of zero_rule have their own plan."""
    step = lambda s, row: predict_row(s, row, settings)
    return fold_by_key(series, ["metric_name"], ["timestamp", "ingest_seq"], State, step, ADDED, carry, "prediction", lambda s, rows: with_rolling(s, rows, settings))
