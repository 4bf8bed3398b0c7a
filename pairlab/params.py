"""Default parameters; every operator takes them as plain arguments too."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    """Fixed values of the research setup, in one place."""

    # cleaning
    calendar_start: str = "2003-01-01"
    calendar_end: str = "2021-06-30"
    fixed_holidays: tuple[str, ...] = ("01-01", "01-26", "05-01", "08-15", "10-02", "12-25")
    min_symbols_per_day: int = 100
    phantom_jump: float = 0.65
    liquidity_window: int = 60
    liquidity_min_periods: int = 20
    liquidity_floor: float = 1e7
    max_gap_days: int = 10
    min_history_days: int = 756
    gate_jump: float = 0.40
    gate_from: str = "2011-01-01"
    smooth_tolerance: float = 0.15
    # screening
    correlation_threshold: float = 0.50
    correlation_days: int = 504
    # cointegration
    train_days: int = 1008
    min_train_days: int = 756
    fdr_alpha: float = 0.05
    half_life_days: tuple[float, float] = (5.0, 60.0)
    hurst_max: float = 0.5
    hurst_lag: int = 100
    # signals
    z_window: int = 60
    entry_z: float = 2.0
    exit_z: float = 0.5
    stop_z: float = 3.5
    max_holding: int = 60
    holding_multiplier: float = 3.0
    # backtest
    test_days: int = 252
    cost_bps_per_leg: float = 25.0
    periods_per_year: int = 252
    # intraday
    bars_per_session: int = 375
    warmup_bars: int = 15
    fixed_cost_bps: float = 4.5
    spread_ladder_bps: tuple[float, ...] = (1.0, 3.0, 5.0, 8.0)
    liquidity_fill: float = 0.90
    probe_days: int = 365
    probe_forward_days: int = 180
    ou_min_obs: int = 60
    half_life_minutes: dict[str, tuple[float, float]] = field(default_factory=lambda: {"A": (30.0, 120.0), "B": (120.0, 1875.0)})


DEFAULTS = Params()
