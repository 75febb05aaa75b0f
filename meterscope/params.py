"""Constants of the analyses, as one parameter object that callers may change."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    carry_min: int = 15  # minutes that a sample holds for
    glitch_factor: float = 50.0  # a step beyond this many medians is a decoding error
    glitch_floor: float = 1000.0
    glitch_positives: int = 3  # positive hourly steps before a median is trusted
    lookback_h: int = 48  # hours before a span that its first step may start from
    regress_least: int = 5  # buckets of a regression
    max_lag: int = 5
    lag_top: int = 8
    lag_least: int = 4
    epsilon: float = 1e-9
    screen_least_days: int = 3
    screen_most_days: int = 60
    screen_coverage: float = 0.90
    stale_min: int = 30
    dropout_min: int = 15
    source_min: int = 10
    alive_s: int = 60
    bill_r_buckets: int = 24
    windows_most: int = 20
    bucket_target: int = 150
    bucket_ladder: tuple[int, ...] = (1, 2, 5, 10, 15, 30, 60, 120, 240)  # minutes
    auto_delta_w: float = 400.0
    auto_base_ewma: float = 0.02
    auto_dev_ewma: float = 0.05
    auto_cap_min: int = 15
    auto_discard_min: int = 3
    auto_cooldown_min: int = 5


DEFAULTS = Params()

#: Endpoint type codes of each commodity (fixed values).
COMMODITIES = {"electric": (4, 5, 7, 8, 12, 13), "gas": (2, 9, 156, 157, 158, 159, 160), "water": (11, 171, 172)}
#: Counter moduli: SCM has 24 bits, all others 32.
SCM_MODULUS, WIDE_MODULUS = 16777216.0, 4294967296.0
#: Statistic and sensor units in kWh or W (fixed values); all others count 1.
ENERGY_UNITS = {"WH": 0.001, "MWH": 1000.0}
SENSOR_UNITS = {"KW": 1000.0, "WH": 0.001, "MWH": 1000.0}
