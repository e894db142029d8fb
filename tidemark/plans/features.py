"""The master feature pipeline: one plan for scans, studies and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import indicators as ind
from ..operators.joins import asof, asof_series, weekly_bars
from ..operators.kernels import with_recursions
from ..sources.calendar import expected_week_ends

WEEKLY_EMAS = ("EMA10_W", "EMA20_W", "EMA89_W", "EMA200_W")


def market_regime(index_bars: DataFrame, cfg: Config = Config()) -> DataFrame:
    """session_date, index_close, the index's averages and BULL, BEAR or NEUTRAL; null before the long average exists."""
    r = cfg.regime
    periods = {"Index_EMA20": r.index_ema_fast, "Index_EMA50": r.index_ema_medium, "Index_EMA89": r.index_ema_structural, "Index_EMA200": r.index_ema_long}
    one = with_recursions(index_bars.select(F.lit("index").alias("symbol"), "session_date", "close"), periods, "sma")
    p, mid, long = F.col("close"), F.col("Index_EMA50"), F.col("Index_EMA200")
    state = F.when(long.isNull(), F.lit(None).cast("string")).when(F.coalesce((p > mid) & (mid > long), F.lit(False)), "BULL").when(F.coalesce((p < mid) & (mid < long), F.lit(False)), "BEAR").otherwise("NEUTRAL")
    return one.select("session_date", F.col("close").alias("index_close"), *periods, state.alias("Market_Regime"))


def weekly_context(bars: DataFrame, calendar: DataFrame, cfg: Config = Config(), keys=("symbol",)) -> DataFrame:
    """Weekly bars with their averages, known from expected_week_end on."""
    weekly = weekly_bars(bars, expected_week_ends(calendar), keys).withColumn("session_date", F.col("week_end"))
    return with_recursions(weekly, {f"{e}_W": n for e, n in cfg.ema.periods.items()}, cfg.ema.seed_method, keys=keys)


def features(bars: DataFrame, index_bars: DataFrame, calendar: DataFrame, cfg: Config = Config(), keys=("symbol",)) -> DataFrame:
    """One row for each bar. keys: what tells a series apart; walk-forward and grids add their fold or cell."""
    atr = f"ATR{cfg.volatility.atr_period}"
    d = with_recursions(bars.select(*keys, "session_date", "open", "high", "low", "close", "volume"), cfg.ema.periods, cfg.ema.seed_method, (atr, cfg.volatility.atr_period), keys)
    return assembled(d, weekly_context(bars, calendar, cfg, keys), index_bars, calendar, cfg, keys, bars)


def assembled(d: DataFrame, weekly: DataFrame, index_bars: DataFrame, calendar: DataFrame, cfg: Config = Config(), keys=("symbol",), bars: DataFrame | None = None) -> DataFrame:
    """Everything behind the recursions, from bars with averages and weekly bars with theirs. bars: the same without."""
    atr, c = f"ATR{cfg.volatility.atr_period}", cfg.definitions
    known = weekly.select(*keys, F.col("week_end").alias("Weekly_Period_End"), *WEEKLY_EMAS, F.col("expected_week_end").alias("Weekly_Availability_Date"))
    d = asof_series(d, market_regime(index_bars, cfg), ["Market_Regime", "index_close"], calendar, bars)
    d = asof(d, known, "Weekly_Availability_Date", ["Weekly_Period_End", *WEEKLY_EMAS, "Weekly_Availability_Date"], keys)
    d = ind.with_crossovers(d, keys)
    d = ind.with_alignment(ind.with_alignment(d), "_W", "Weekly_State")
    d = d.withColumn("MTF_State", ind.mtf_state(F.col("Weekly_State"), F.col("Daily_State")))
    d = ind.with_compression(ind.with_cluster(d), cfg.cluster, keys)
    d = ind.with_expansion(d, cfg.cluster, keys)
    d = ind.with_slopes(d, cfg.volatility.ema_slope_lookback_days, keys)
    d = ind.with_definitions(d, c.sequential_crossover_max_gap_sessions, c.compression_expansion_lookahead_days, c.enabled, keys)
    d = ind.with_atr_distances(d, atr)
    d = ind.with_swings(d, cfg.swing.left_bars, cfg.swing.right_bars, keys)
    d = ind.with_pullback(d, cfg.pullback, atr, keys)
    d = ind.with_entries(d, cfg.entries, keys)
    d = ind.with_stops(d, atr, cfg.atr_stop_multiple)
    d = ind.with_structure(d, keys)
    d = ind.with_relative_strength(d, cfg.relative_strength, keys)
    d = ind.with_liquidity(d, cfg.liquidity.volume_window_fast_days, cfg.liquidity.volume_window_slow_days, keys)
    return ind.with_signal_state(d)
