"""Typed configuration; every default is a parameter of some operator."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Ema:
    fast: int = 10
    medium: int = 20
    structural: int = 89
    long: int = 200
    seed_method: str = "sma"

    @property
    def periods(self) -> dict[str, int]:
        """Columns are named by role; the names are those of the default periods."""
        return {"EMA10": self.fast, "EMA20": self.medium, "EMA89": self.structural, "EMA200": self.long}


@dataclass(frozen=True)
class Swing:
    left_bars: int = 5
    right_bars: int = 5


@dataclass(frozen=True)
class Volatility:
    atr_period: int = 14
    ema_slope_lookback_days: int = 10


@dataclass(frozen=True)
class Cluster:
    width_lookback: int = 252
    compression_percentile: float = 0.20
    expansion_percentile: float = 0.80
    flat_band_percentile: float = 0.10
    width_slope_lookback_days: int = 5
    percentile_min_periods: int = 30
    #: "coded": share of the window at least as wide as now; "spec": share at most as wide.
    percentile_mode: str = "coded"


@dataclass(frozen=True)
class Definitions:
    sequential_crossover_max_gap_sessions: int = 10
    compression_expansion_lookahead_days: int = 10
    enabled: tuple[str, ...] = ("A", "B", "C", "D")


@dataclass(frozen=True)
class Pullback:
    shallow_atr: float = 1.0
    moderate_atr: float = 2.5
    deep_atr: float = 4.0
    breakout_memory_bars: int = 60


@dataclass(frozen=True)
class Regime:
    benchmark: str = "NIFTY50"
    custom_symbol: str | None = None
    index_ema_fast: int = 20
    index_ema_medium: int = 50
    index_ema_structural: int = 89
    index_ema_long: int = 200


@dataclass(frozen=True)
class Liquidity:
    enabled: bool = False
    min_price: float = 0.0
    min_average_daily_traded_value: float = 0.0
    min_average_volume: float = 0.0
    volume_window_fast_days: int = 20
    volume_window_slow_days: int = 50


@dataclass(frozen=True)
class Costs:
    brokerage_pct: float = 0.03
    stt_pct: float = 0.10
    stt_buy_pct: float | None = 0.10
    stt_sell_pct: float | None = 0.10
    exchange_charges_pct: float = 0.00345
    gst_pct: float = 0.18
    stamp_duty_pct: float = 0.0
    stamp_duty_buy_only: bool = True
    sebi_charges_pct: float = 0.0
    slippage_pct: float = 0.05


@dataclass(frozen=True)
class Backtest:
    initial_capital: float = 1_000_000.0
    max_concurrent_positions: int = 20
    max_position_pct_of_equity: float = 100.0
    fixed_horizon_days: int = 20
    minimum_trade_qty: int = 1
    exit_rule: str = "STOP_ONLY_RESEARCH"
    entry_model_col: str = "Any_Entry_Triggered"
    cost_scenario: str = "base_cost"
    risk_budget_basis: str = "EQUITY"


@dataclass(frozen=True)
class WalkForward:
    train_years: float = 3.0
    test_years: float = 1.0
    step_years: float = 1.0


@dataclass(frozen=True)
class Config:
    ema: Ema = field(default_factory=Ema)
    swing: Swing = field(default_factory=Swing)
    volatility: Volatility = field(default_factory=Volatility)
    cluster: Cluster = field(default_factory=Cluster)
    definitions: Definitions = field(default_factory=Definitions)
    pullback: Pullback = field(default_factory=Pullback)
    entries: tuple[str, ...] = ("A", "B", "C", "D", "E")
    regime: Regime = field(default_factory=Regime)
    relative_strength: tuple[int, ...] = (20, 60, 120)
    liquidity: Liquidity = field(default_factory=Liquidity)
    max_stale_sessions: int = 5
    refresh_overlap_sessions: int = 10
    eod_data_cutoff: str = "16:00"
    min_expected_constituents: int = 150
    execution_model: str = "next_open"
    risk_per_trade_pct: float = 0.5
    atr_stop_multiple: float = 2.5
    costs: Costs = field(default_factory=Costs)
    horizons_days: tuple[int, ...] = (1, 3, 5, 10, 20, 40)
    walk_forward: WalkForward = field(default_factory=WalkForward)
    backtest: Backtest = field(default_factory=Backtest)
    random_seed: int = 42

    def hash(self) -> str:
        """16 hex digits of the SHA-256 of the configuration as sorted JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()[:16]


def _built(kind, values: dict):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings of {kind.__name__}: {sorted(unknown)}")
    default = kind()
    out = {}
    for k, v in values.items():
        now = getattr(default, k)
        out[k] = _built(type(now), v) if is_dataclass(now) else tuple(v) if isinstance(now, tuple) else v
    return kind(**out)


def load_config(path: str | None = None) -> Config:
    """Settings of a JSON or TOML file over the defaults; the defaults if path is None or has no file."""
    import os
    import tomllib

    if path is None or not os.path.exists(path):
        return Config()
    with open(path, "rb") as f:
        return _built(Config, tomllib.load(f) if path.endswith(".toml") else json.load(f))


#: What each parameter rests on; unlisted ones are UNCLASSIFIED.
CATEGORIES = {
    "ema.fast": "SOURCE_DERIVED_RULE", "ema.medium": "SOURCE_DERIVED_RULE", "ema.structural": "SOURCE_DERIVED_RULE", "ema.long": "SOURCE_DERIVED_RULE",
    "ema.seed_method": "MATHEMATICAL_DEFINITION", "swing.left_bars": "ENGINEERING_DECISION", "swing.right_bars": "ENGINEERING_DECISION",
    "volatility.atr_period": "SOURCE_DERIVED_RULE", "cluster.width_lookback": "RESEARCH_HYPOTHESIS", "cluster.compression_percentile": "RESEARCH_HYPOTHESIS",
    "cluster.expansion_percentile": "RESEARCH_HYPOTHESIS", "liquidity.enabled": "OPTIONAL_FILTER", "costs.brokerage_pct": "PLACEHOLDER_UNVERIFIED",
    "costs.slippage_pct": "PLACEHOLDER_UNVERIFIED", "execution_model": "ENGINEERING_DECISION",
}


def classify(path: str) -> str:
    return CATEGORIES.get(path, "UNCLASSIFIED")


def audit_config(cfg: Config) -> list[str]:
    """Warnings about settings that make results hard to trust."""
    out = []
    if cfg.costs == Costs():
        out.append("costs are unverified placeholders")
    if cfg.execution_model == "same_close":
        out.append("same_close fills at the price that gives the signal")
    if not cfg.ema.fast < cfg.ema.medium < cfg.ema.structural < cfg.ema.long:
        out.append("EMA periods don't ascend")
    return out


def resolve_benchmark(cfg: Config) -> str:
    if cfg.regime.benchmark == "NIFTY50":
        return "^NSEI"
    if cfg.regime.benchmark == "CUSTOM" and cfg.regime.custom_symbol:
        return cfg.regime.custom_symbol
    raise ValueError(f"no verified symbol for benchmark {cfg.regime.benchmark!r}")
