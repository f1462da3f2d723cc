"""Settings of the monitoring engine. Values are part of its observable behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fixed values that are not settings.
EPS = 1e-6
MAX_Z_HISTORY = 5000
BUSINESS_UNIT_FACTORS = {"AA": 1.00, "BB": 1.02, "CC": 0.98}
ALIGNED_LIMIT, SAME_SECOND_LIMIT, RECENT_LIMIT = 28, 60, 120
LEVELS = ("P0", "P1", "P2", "P3")
PRIORITY_SCORES = {"P0": 1.0, "P1": 0.8, "P2": 0.5, "P3": 0.3}
CANDIDATE_PERIODS = {"1s": (60, 300, 3600, 86400), "1m": (60, 1440), "5m": (12, 288), "10m": (6, 144), "30m": (48,)}


@dataclass(frozen=True)
class Settings:
    timezone: str = "Asia/Shanghai"
    history_weeks_required: int = 4
    max_missing_fill: int = 3
    jump_clip_multiplier: float = 10.0
    jump_clip_history_window: int = 600
    second_consecutive_points: int = 3
    minute_consecutive_points: int = 2
    global_lower_quantile: float = 0.025
    global_upper_quantile: float = 0.975
    kde_refresh_every_points: int = 300
    kde_refresh_interval_sec: int = 3600
    local_boxplot_window: int = 60
    local_regression_window: int = 30
    local_nsigma_window: int = 60
    local_trend_window: int = 15
    periodic_ratio_threshold: float = 0.60
    periodic_min_matches: int = 3
    periodic_week_lookback: int = 4
    confidence_p0: float = 0.60
    confidence_p1: float = 0.40
    alert_merge_window_sec: int = 300
    alert_upgrade_window_sec: int = 600
    recovery_normal_points: int = 3
    zero_rule_floor: float = 1e-6
    zero_rule_drop_ratio: float = 0.10
    eligibility_retry_interval_sec: int = 86400
    eligibility_refresh_interval_sec: int = 604800
    eligibility_history_sec: int = 28 * 86400
    state_ttl_sec: int = 604800
    data_retention_sec: int = 2592000
    second_history_window: int = 4000
    minute_history_window: int = 600
    anomaly_window: int = 4000
    #: "plain", or "joint": robust lines and their scale by one convex minimisation.
    line_rule: str = "plain"
    #: "plain", or "covariance": kernels scaled by the sample deviation, on 1,024 points.
    density_rule: str = "plain"
    priority_route_seconds: dict[str, int] = field(default_factory=lambda: {"P0": 60, "P1": 300, "P2": 600, "P3": 1800})


DEFAULTS = Settings()
