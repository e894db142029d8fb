"""Hand-computed cases, and invariances that keep the future out of the past."""

import datetime as dt
import json
import math
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import config as conf
from tidemark import cli
from tidemark.functions import costs, stats
from tidemark.operators import checks, joins, kernels, prices
from tidemark.operators import indicators as ind
from tidemark.plans import backtest as bt
from tidemark.plans import events as evs
from tidemark.plans import features as fts
from tidemark.plans import research, scan
from tidemark.sources import bars as src
from tidemark.sources import calendar as cal
from tidemark.sources import sinks
from tidemark.streaming import ingest

D = dt.date
BARS = "symbol string, session_date date, open double, high double, low double, close double, volume double"


def business_days(start, n):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def bars_of(spark, symbol, days, close, open_=None, high=None, low=None, volume=1e5):
    open_ = close if open_ is None else open_
    high = [c + 1 for c in close] if high is None else high
    low = [c - 1 for c in close] if low is None else low
    rows = [(symbol, d, float(o), float(h), float(lo), float(c), float(volume)) for d, o, h, lo, c in zip(days, open_, high, low, close)]
    return spark.createDataFrame(rows, BARS)


def random_walk(spark, symbols=("AAA", "BBB"), n=400, seed=7):
    out = None
    for k, s in enumerate(symbols):
        rng = np.random.default_rng(seed + k)
        close = 100 + np.cumsum(rng.normal(0.05, 1.2, n))
        open_ = close + rng.normal(0, 0.3, n)
        high, low = np.maximum(open_, close) + rng.uniform(0.1, 1, n), np.minimum(open_, close) - rng.uniform(0.1, 1, n)
        df = bars_of(spark, s, business_days("2018-01-01", n), close.tolist(), open_.tolist(), high.tolist(), low.tolist(), volume=1e5 + k)
        out = df if out is None else out.unionByName(df)
    return out


SMALL = conf.Config(ema=conf.Ema(5, 8, 13, 21), regime=conf.Regime(index_ema_fast=5, index_ema_medium=8, index_ema_structural=13, index_ema_long=21))


def test_ema_cases():
    assert np.allclose(kernels.ema(np.full(50, 42.0), 10)[9:], 42)
    e = kernels.ema(np.arange(1.0, 101), 10)
    assert (np.diff(e[9:]) > 0).all() and np.isnan(e[:9]).all()
    assert np.isnan(kernels.ema(np.arange(3.0), 10)).all()
    assert kernels.ema(np.arange(1.0, 11), 5)[4] == 3
    assert kernels.ema(np.array([2.0, 4]), 3, "first_obs").tolist() == [2, 3]
    x = np.arange(1.0, 30)
    x[15] = np.nan
    assert np.isnan(kernels.ema(x, 5)[15:]).all()
    with pytest.raises(ValueError):
        kernels.ema(x, 0)
    with pytest.raises(ValueError):
        kernels.ema(x, 3, "median")
    s = pd.Series(np.random.default_rng(0).normal(100, 5, 300))
    assert np.allclose(kernels.ema(s.to_numpy(), 20, "first_obs"), s.ewm(span=20, adjust=False).mean())
    assert np.allclose(kernels.wilder(s.to_numpy(), 14)[13:], s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()[13:])


def test_rolling_indicators_match_pandas(spark):
    one = random_walk(spark, ("AAA",), 320)
    got = ind.with_expansion(ind.with_compression(ind.with_cluster(kernels.with_recursions(one, SMALL.ema.periods)), SMALL.cluster), SMALL.cluster).toPandas().sort_values("session_date")
    width = got["Cluster_Width_Pct"]
    share = width.rolling(252, min_periods=30).apply(lambda w: (w[-1] <= w).mean(), raw=True)
    assert np.allclose(got["Cluster_Width_Percentile"].astype(float), share, equal_nan=True)
    roll = width.diff(5).rolling(252, min_periods=30)
    lo, hi = roll.quantile(0.45), roll.quantile(0.55)
    state = np.select([width.diff(5) > hi, width.diff(5) < lo], ["EXPANDING", "CONTRACTING"], "FLAT")
    known = lo.notna() & width.diff(5).notna()
    assert (got["Cluster_Expansion_State"][known] == state[known]).all() and got["Cluster_Expansion_State"][~known].isna().all()
    slope = width.rolling(5).apply(lambda y: np.polyfit(range(5), y, 1)[0])
    assert np.allclose(got["Cluster_Width_Slope"].astype(float), slope, equal_nan=True)


def test_future_bars_change_nothing(spark):
    """Features up to a date are the same whether or not later bars exist."""
    full = random_walk(spark, n=330)
    index = bars_of(spark, "I", business_days("2018-01-01", 330), [100 + math.sin(i / 9) * 5 for i in range(330)]).drop("symbol")
    calendar = cal.calendar_table(full.select("session_date"))
    cut = business_days("2018-01-01", 300)[-1]
    before = F.col("session_date") <= F.lit(cut)
    a = fts.features(full, index, calendar, SMALL).where(before)
    b = fts.features(full.where(before), index.where(before), calendar, SMALL)
    # pivots are marked at the extreme, right_bars rows ahead of their confirmation
    a, b = (x.drop("Is_Swing_Low", "Is_Swing_High").toPandas().sort_values(["symbol", "session_date"]).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b[a.columns])
    assert a["Signal_State"].notna().any() and a["Any_Entry_Triggered"].any() and a["EMA200_W"].notna().any()


def test_weekly_context_waits_for_its_week(spark):
    days = business_days("2024-01-01", 10)
    daily = bars_of(spark, "A", [d for d in days if d != D(2024, 1, 5)], range(9))
    calendar = cal.calendar_table(spark.createDataFrame([(d,) for d in days], "session_date date"))
    weekly = joins.weekly_bars(daily, cal.expected_week_ends(calendar))
    got = {r.session_date: r.week_end for r in joins.asof(daily, weekly.select("symbol", "week_end", "expected_week_end"), "expected_week_end", ["week_end"]).collect()}
    # the first week's last bar is Thursday's, but the week ends on Friday
    assert got[D(2024, 1, 4)] is None and got[D(2024, 1, 8)] == D(2024, 1, 4) and got[D(2024, 1, 12)] == D(2024, 1, 12)


def test_swing_needs_a_single_extreme(spark):
    low = [9, 8, 7, 6, 5, 3, 5, 6, 7, 8, 9, 9, 8, 7, 6, 4, 4, 6, 7, 8, 9, 9]
    df = bars_of(spark, "A", business_days("2024-01-01", len(low)), [10] * len(low), low=low)
    rows = ind.with_swings(df).orderBy("session_date").collect()
    assert [i for i, r in enumerate(rows) if r.Is_Swing_Low] == [5]
    assert [r.Swing_Low_Stop for r in rows[9:11]] == [None, 3] and rows[10].Confirmed_Swing_Low_Date == rows[5].session_date and rows[10].Confirmed_Swing_Low_Available_Date == rows[10].session_date


def test_percentile_with_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 10.0), ("d", None)], "symbol string, RS_60D double").withColumn("session_date", F.lit("2024-01-01").cast("date"))
    assert {r.symbol: r.RS_Percentile for r in ind.rs_percentile(df).collect()} == {"a": 50, "b": 50, "c": 100, "d": None}


def test_forward_returns(spark):
    days = business_days("2023-01-02", 15)
    close = [100, 101, 102, 103, 104, 105, 110, 112, 108, 115, 120, 118, 125, 130, 128]
    bars = bars_of(spark, "A", days, close, high=[c + 2 for c in close], low=[c - 2 for c in close])
    calendar = cal.calendar_table(bars.select("session_date"))
    feats = bars.withColumns({c: F.lit(False) for c in list(ind.ENTRIES.values())[1:]} | {"EntryA_FreshAlignment": F.col("session_date") == F.lit(days[5]), "Market_Regime": F.lit("BULL")})
    cfg = conf.Config(horizons_days=(1, 2, 3))
    e = evs.event_study(feats, calendar, cfg).first()
    assert (e.execution_date, e.entry_price, e.fwd_ret_1d) == (days[6], 110, 0) and math.isclose(e.fwd_ret_2d, (112 - 110) / 110 * 100)
    assert math.isclose(e.mfe_pct, (114 / 110 - 1) * 100) and e.time_to_mfe == 1 and math.isclose(e.mae_pct, (106 / 110 - 1) * 100) and e.time_to_mae == 2
    gap = calendar.where(F.col("session_date") != F.lit(days[6]))
    gone = evs.event_study(feats.where(F.col("session_date") != F.lit(days[6])), calendar, cfg)
    assert gone.count() == 0 and gap.count() == 14
    same = evs.event_study(feats, calendar, conf.Config(horizons_days=(1, 2, 3), execution_model="same_close")).first()
    assert same.entry_price == 105 and math.isclose(same.fwd_ret_1d, (110 / 105 - 1) * 100)


def fold_input(bars, signal_row, stop, days):
    no = {d: i for i, d in enumerate(days)}
    flag = F.col("session_date") == F.lit(days[signal_row])
    return bars.withColumns({"Any_Entry_Triggered": flag, "Swing_Low_Stop": F.lit(float(stop)), "Confirmed_Swing_Low_Date": F.lit(days[0]), "Confirmed_Swing_Low_Available_Date": F.lit(days[0])}), cal.calendar_table(bars.select("session_date")), no


def test_same_day_stop(spark):
    days = business_days("2021-01-01", 10)
    close = [100, 101, 90, 91, 92, 93, 94, 95, 96, 97]
    low = [c - 1 for c in close]
    low[2] = 80
    feats, calendar, _ = fold_input(bars_of(spark, "A", days, close, low=low), 1, 85, days)
    (t,) = bt.trades(bt.run_backtests(feats, calendar)).collect()
    assert (t.execution_date, t.exit_date, t.exit_reason, t.exit_price, t.holding_period_sessions) == (days[2], days[2], "STOP", 85, 0)


def test_entry_day_extremes(spark):
    days = business_days("2021-01-01", 10)
    close = [100, 101, 105, 106, 107, 108, 109, 109.5, 109.8, 110]
    high = [c + 0.5 for c in close]
    high[2] = 120
    feats, calendar, _ = fold_input(bars_of(spark, "A", days, close, high=high, low=[c - 0.5 for c in close]), 1, 90, days)
    result = bt.run_backtests(feats, calendar, scenarios={"open": {}, "close": {"execution_model": "next_close"}})
    got = {t.scenario: t for t in bt.trades(result).collect()}
    assert math.isclose(got["open"].mfe_pct, (120 / 105 - 1) * 100) and got["close"].mfe_pct < 10 and got["open"].exit_reason == "END_OF_DATA_SYMBOL"
    last = bt.equity(result).where("scenario = 'open'").orderBy(F.desc("session_date")).first()
    assert last.open_positions == 0 and math.isclose(last.equity, 1e6 + got["open"].net_pnl)
    assert bt.equity(result).where("scenario = 'open'").count() == 10


def test_fold_rules(spark):
    days = business_days("2021-01-01", 10)
    feats, calendar, _ = fold_input(bars_of(spark, "A", days, list(range(100, 110))), 1, 200, days)
    assert [r.reason for r in bt.skipped(bt.run_backtests(feats, calendar)).collect()] == ["invalid_risk_geometry"]
    feats, calendar, _ = fold_input(bars_of(spark, "A", days, list(range(100, 110))), 9, 50, days)
    assert [r.reason for r in bt.skipped(bt.run_backtests(feats, calendar)).collect()] == ["data_gap"]
    gap = bars_of(spark, "A", days, [100] * 5 + [80] * 5, open_=[100] * 5 + [79] * 5)
    feats, calendar, _ = fold_input(gap, 1, 90, days)
    (t,) = bt.trades(bt.run_backtests(feats, calendar)).collect()
    assert (t.exit_reason, t.exit_price) == ("STOP_GAP_THROUGH", 79)
    feats, calendar, _ = fold_input(bars_of(spark, "A", days, [100] * 10), 1, 90, days)
    (t,) = bt.trades(bt.run_backtests(feats, calendar, scenarios={"x": {"exit_rule": "FIXED_HORIZON", "fixed_horizon_days": 3}})).collect()
    assert (t.exit_reason, t.exit_date) == ("FIXED_HORIZON", days[5])
    two = bars_of(spark, "A", days, [100] * 10).unionByName(bars_of(spark, "B", days, [100] * 10))
    feats, calendar, _ = fold_input(two, 1, 90, days)
    only = bt.trades(bt.run_backtests(feats, calendar, scenarios={"x": {"max_concurrent_positions": 1}})).collect()
    assert [t.symbol for t in only] == ["A"]
    first = spark.createDataFrame([("A", 2), ("B", 1)], "symbol string, priority int")
    assert [t.symbol for t in bt.trades(bt.run_backtests(feats, calendar, scenarios={"x": {"max_concurrent_positions": 1}}, priority=first)).collect()] == ["B"]
    with pytest.raises(Exception, match="exit rule"):
        bt.run_backtests(feats, calendar, scenarios={"x": {"exit_rule": "HOPE"}}).count()


def test_backtest_streams(spark):
    """Dates that part over batches, missing bars of held symbols, and many symbols for few slots give one book."""
    rng = np.random.default_rng(7)
    days = business_days("2021-01-01", 60)
    frames = []
    for k in range(12):
        close = (100 * np.exp(np.cumsum(rng.normal(0, 0.03, 60)))).round(2).tolist()
        frames.append(bars_of(spark, f"S{k:02}", days, close, low=[x * 0.97 for x in close], high=[x * 1.03 for x in close]))
    bars = reduce(lambda a, b: a.unionByName(b), frames).where("NOT (symbol = 'S03' AND dayofmonth(session_date) = 12)")
    feats, calendar, _ = fold_input(bars, 1, 90, days)
    feats = feats.withColumn("Any_Entry_Triggered", F.pmod(F.xxhash64("symbol", "session_date"), F.lit(5)) == 0).withColumn("Swing_Low_Stop", F.col("close") * 0.95)
    scenarios = {"a": {"max_concurrent_positions": 4}, "b": {"exit_rule": "FIXED_HORIZON", "fixed_horizon_days": 5, "execution_model": "next_close", "max_position_pct_of_equity": 10.0}, "c": {"execution_model": "same_close"}}
    found = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        result = bt.run_backtests(feats, calendar, scenarios=scenarios)
        found.append(sorted(map(str, result.drop("cash", "equity", "positions_value").collect())))
        for name in scenarios:
            curve = bt.equity(result).where(F.col("scenario") == name).orderBy("session_date").collect()
            made = bt.trades(result).where(F.col("scenario") == name).agg(F.sum("net_pnl")).first()[0] or 0.0
            assert math.isclose(curve[-1].equity, 1e6 + made) and min(r.cash for r in curve) >= -1e-6 and curve[-1].open_positions == 0
            assert name != "a" or max(r.open_positions + r.pending_orders for r in curve) == 4
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len(found[0]) > 200


def test_resolution_by_brute_force():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 7, 8, 33):
        x = rng.normal(0, 1, n)
        x[rng.random(n) < 0.1] = np.nan
        start, limit = rng.integers(0, n + 1, 50), rng.normal(-0.5, 1, 50)
        want = [next((j for j in range(a, n) if x[j] <= y), n) for a, y in zip(start, limit)]
        assert bt.first_at_or_below(x, start, limit).tolist() == want
        first, last = rng.integers(0, n, 50), rng.integers(0, n, 50)
        got = bt.best_between(x, first, last, np.fmax)
        want = [np.nan if a > b or np.isnan(x[a : b + 1]).all() else np.nanmax(x[a : b + 1]) for a, b in zip(first, last)]
        assert np.array_equal(got, want, equal_nan=True)


def test_sizes_and_costs(spark):
    one = spark.range(1).select(costs.position_size(F.lit(1e6), F.lit(100.0), F.lit(95.0)).alias("a"), costs.position_size(F.lit(1e6), F.lit(100.0), F.lit(100.0)).alias("b"), costs.position_size(F.lit(1e6), F.lit(100.0), F.lit(99.0), side="SHORT").alias("c"), costs.position_size(F.lit(10.0), F.lit(100.0), F.lit(50.0)).alias("d")).first()
    assert tuple(one.a) == (1000, "ok") and one.b.reason == one.c.reason == "invalid_risk_geometry" and one.d.reason == "below_min_qty"
    assert costs.size(1e6, 100, 95, 0.5) == (1000, "ok") and costs.size(1e6, 100, 100, 0.5)[0] == 0
    assert math.isclose(costs.cost_fraction(), 0.0018947100000000002) and costs.cost_fraction(scenario="zero_cost") == 0
    c = conf.Costs(stt_sell_pct=0.2, stamp_duty_pct=0.01)
    assert costs.round_trip_fraction(c) == costs.cost_fraction(c, side="buy") + costs.cost_fraction(c, side="sell") and costs.cost_fraction(c, side="sell") > costs.cost_fraction(c, side="buy")


def test_splits(spark):
    days = business_days("2024-01-01", 10)
    raw = bars_of(spark, "A", days, [200] * 5 + [100] * 5, volume=100).withColumn("stock_splits", F.when(F.col("session_date") == F.lit(days[5]), 2.0).otherwise(0.0))
    assert {r.close for r in prices.adjusted(raw).collect()} == {100} and sorted({r.volume for r in prices.adjusted(raw).collect()}) == [100, 200]
    early = prices.adjusted(raw.where(F.col("session_date") <= F.lit(days[3])), as_of=str(days[3]))
    assert {r.close for r in early.collect()} == {200} and {r.close for r in prices.adjusted(raw, as_of=str(days[3])).collect()} == {200, 100}
    with pytest.raises(ValueError):
        prices.adjusted(raw, "TOTAL_RETURN")
    with pytest.raises(ValueError):
        prices.adjusted(raw.drop("high"))


def test_equity_statistics(spark):
    def curve(values, days):
        return spark.createDataFrame([(d, float(v), 0.0) for d, v in zip(days, values)], "session_date date, equity double, positions_value double")

    r = stats.portfolio_stats(curve([100, 120, 90, 110], business_days("2024-01-01", 4))).first()
    assert math.isclose(r.max_drawdown_pct, -25) and r.max_drawdown_duration_sessions == 2
    assert stats.portfolio_stats(curve([100, 90, 95, 99, 101, 100], business_days("2024-01-01", 6))).first().max_drawdown_duration_sessions == 3
    year = stats.portfolio_stats(curve([100_000, 200_000], [D(2023, 1, 1), D(2024, 1, 1)])).first()
    assert math.isclose(year.cagr_pct, (2 ** (365.25 / 365) - 1) * 100)
    x = [100.0]
    for m in (1.02, 0.99, 1.02, 0.99):
        x.append(x[-1] * m)
    ret = np.array([0.02, -0.01, 0.02, -0.01])
    assert math.isclose(stats.portfolio_stats(curve(x, business_days("2024-01-01", 5))).first().sharpe, ret.mean() * 252 / (ret.std(ddof=1) * 252**0.5))
    trades = spark.createDataFrame([(50.0, 1000, 5.0), (100.0, 500, -2.0), (200.0, 250, 1.0)], "entry_price double, quantity long, net_pnl double")
    t = stats.portfolio_stats(curve([100_000] * 252, business_days("2024-01-01", 252)), trades).first()
    assert math.isclose(t.notional_turnover_pct, 150) and t.trade_count == 3 and math.isclose(t.profit_factor, 3)


def test_return_statistics(spark):
    r = [1.0, -2.0, 3.5, 0.0, 8.0]
    got = spark.createDataFrame([(x,) for x in [*r, None]], "r double").agg(*stats.performance(F.col("r"))).first()
    s = pd.Series(r)
    assert (got.n_trades, got.win_rate_pct, got.median_return_pct) == (5, 60, s.median()) and math.isclose(got.skew, s.skew()) and math.isclose(got.std_return_pct, s.std()) and math.isclose(got.profit_factor, 12.5 / 2)
    none = spark.createDataFrame([], "r double").agg(*stats.performance(F.col("r"))).first()
    assert none.n_trades == 0 and none.avg_return_pct is None


def test_bootstrap_widths(spark):
    rng = np.random.default_rng(5)
    rows = [(f"T{t}", D(2024, 1, 1) + dt.timedelta(d), float(shock + rng.normal(0, 0.5))) for d, shock in enumerate(rng.normal(0, 5, 6)) for t in range(10)]
    ev = spark.createDataFrame(rows, "symbol string, execution_date date, r double")
    a, b = stats.cluster_bootstrap(ev, "r", "symbol", 400).first(), stats.cluster_bootstrap(ev, "r", "execution_date", 400).first()
    assert a.replicates == b.replicates == 400 and b.ci_high - b.ci_low > a.ci_high - a.ci_low and a.n_clusters == 10
    assert a == stats.cluster_bootstrap(ev, "r", "symbol", 400).first()
    both = stats.two_way_bootstrap(ev, "r", replicates=200).first()
    assert both.ci_low <= min(both.ticker_low, both.date_low) and both.ci_high >= max(both.ticker_high, both.date_high)


def test_two_way_replicates(spark):
    rng = np.random.default_rng(6)
    cell = {(t, d): float(rng.normal(t, 2 + d)) for t in range(8) for d in range(12) if rng.random() < 0.5}
    diagonal = {(i, i): float(i) for i in range(3)}
    for values in (cell, diagonal):
        ev = spark.createDataFrame([(f"T{t}", D(2024, 1, 1) + dt.timedelta(d), v) for (t, d), v in values.items()], "symbol string, execution_date date, r double")
        got = stats.two_way_bootstrap(ev, "r").first()
        assert got.replicates == 2000
        # the definition row by row; without a row of both, the drawn tickers count
        means, (ts, ds) = [], [sorted({k[i] for k in values}) for i in (0, 1)]
        for _ in range(4000):
            a, b = set(rng.choice(ts, len(ts))), set(rng.choice(ds, len(ds)))
            means.append(np.mean([v for (t, d), v in values.items() if t in a and d in b] or [v for (t, d), v in values.items() if t in a]))
        low, high = np.quantile(means, [0.025, 0.975])
        assert abs(got.both_low - low) < 0.12 * (high - low) and abs(got.both_high - high) < 0.12 * (high - low)
    assert stats.two_way_bootstrap(ev, "r", replicates=250).first().replicates == 250
    assert stats.two_way_bootstrap(ev.limit(0), "r").first().replicates == 0


def test_quality(spark):
    days = business_days("2024-01-01", 8)
    good = bars_of(spark, "GOOD", days, [100, 101, 102, 103, 104, 105, 106, 107])
    bad = spark.createDataFrame([("DUP", days[0], 1.0, 2.0, 0.5, 1.0, 1.0)] * 2 + [("NAN", days[0], float("nan"), 2.0, 0.5, 1.0, 1.0), ("INF", days[7], 1.0, float("inf"), 0.5, 1.0, 1.0), ("NEG", days[7], -1.0, 2.0, 0.5, 1.0, 1.0), ("LOW", days[7], 1.0, 0.4, 0.5, 1.0, 1.0)], BARS)
    jump = bars_of(spark, "JUMP", [days[0], days[2], days[7]], [100, 150, 151])
    stale = bars_of(spark, "STALE", days[:2], [100, 101])
    calendar = cal.calendar_table(spark.createDataFrame([(d,) for d in days], "session_date date"))
    got = {r.symbol: r for r in checks.quality_report(good.unionByName(bad).unionByName(jump).unionByName(stale), calendar, str(days[7])).collect()}
    assert got["GOOD"].status == "PASS" and got["GOOD"].eligible
    assert {s for s, r in got.items() if r.status == "FAIL"} == {"DUP", "NAN", "INF", "NEG", "LOW"}
    assert got["JUMP"].status == "WARN" and got["JUMP"].missing_sessions == 5 and got["JUMP"].jumps == 1 and got["JUMP"].eligible
    assert got["STALE"].stale_sessions == 6 and not got["STALE"].eligible
    assert {r.status: r.symbols for r in checks.tally(spark.createDataFrame(list(got.values()))).collect()}["FAIL"] == 5


def test_calendar(spark):
    days = [D(2024, 1, 2), D(2024, 1, 3), D(2024, 1, 5), D(2024, 1, 8)]
    calendar = cal.calendar_table(spark.createDataFrame([(d,) for d in days], "session_date date"))
    near = {r.date: (r.prev_session, r.next_session) for r in cal.neighbours(spark.createDataFrame([(D(2024, 1, 3),), (D(2024, 1, 6),), (D(2024, 3, 1),)], "date date"), calendar).collect()}
    assert near == {D(2024, 1, 3): (D(2024, 1, 2), D(2024, 1, 5)), D(2024, 1, 6): (D(2024, 1, 5), D(2024, 1, 8)), D(2024, 3, 1): (None, None)}
    label = spark.createDataFrame([(D(2021, 1, 3),)], "d date").select(cal.week_label(F.col("d"))).first()[0]
    assert label == "2020-W53"
    gaps = joins.missing_sessions(bars_of(spark, "A", [days[0], days[2]], [1, 2]), calendar).collect()
    assert [r.session_date for r in gaps] == [D(2024, 1, 3)]
    sessions = spark.createDataFrame([(D(2024, 1, 2), "15:30"), (D(2024, 1, 3), "15:30"), (D(2024, 1, 5), None)], "session_date date, close_time string")
    at = lambda d, h, **k: cal.resolve_analysis_date(sessions, dt.datetime(2024, 1, d, h), **k).date
    assert at(3, 15) == D(2024, 1, 2) and at(3, 16) == D(2024, 1, 3) and at(5, 20) == D(2024, 1, 3) and at(6, 1) == D(2024, 1, 5)
    for day, hour, asked in ((3, 12, D(2024, 1, 3)), (3, 17, D(2024, 1, 4)), (3, 17, D(2024, 1, 5)), (5, 20, D(2024, 1, 5))):
        with pytest.raises(cal.DateError):
            at(day, hour, manual=asked)
    assert cal.required_warmup() == 3050 and cal.folds(D(2020, 1, 1), D(2021, 1, 1)) == [] and cal.folds(D(2016, 2, 29), D(2020, 6, 1))[0][2] == D(2019, 2, 28)


def test_sources(spark, tmp_path):
    folder = f"file://{tmp_path}"
    (tmp_path / "day.csv").write_text("TradDt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,TtlTradgVol\n2024-01-02,AAA,EQ,1,2,0.5,1.5,100\n2024-01-02,AAA,BE,1,2,0.5,1.5,100\n2024-01-02,BBB,EQ,3,4,2,3.5,50\n")
    assert [tuple(r) for r in src.exchange_csv(spark, f"{folder}/day.csv", "AAA").collect()] == [("AAA", D(2024, 1, 2), 1, 2, 0.5, 1.5, 100)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(src.DataUnavailable):
        src.exchange_csv(spark, f"{folder}/bad.csv")
    with pytest.raises(src.DataUnavailable, match="x: .*can't be read"):
        src.first_available(src.build_sources(spark, {"x": f"{folder}/none"}))
    (tmp_path / "u.csv").write_text("Company Name,Industry,Symbol\nAlpha, Steel ,AAA \n")
    assert tuple(src.universe_csv(spark, f"{folder}/u.csv", 1).first()) == ("AAA", "Alpha", "Steel")
    with pytest.raises(src.DataUnavailable):
        src.universe_csv(spark, f"{folder}/u.csv", 2)
    cache = src.BarCache(spark, f"{folder}/cache")
    assert cache.read() is None
    stamp = lambda df, at: df.withColumn("ingest_ts", F.lit(at).cast("timestamp"))
    days = business_days("2024-01-01", 3)
    cache.upsert(stamp(bars_of(spark, "A", days, [1, 2, 3]), "2024-02-01"))
    cache.upsert(stamp(bars_of(spark, "A", days[2:], [9]), "2024-02-02"))
    cache.upsert(stamp(bars_of(spark, "A", days[:1], [7]), "2024-01-15"))
    assert [r.close for r in cache.read().orderBy("session_date").collect()] == [1, 2, 9]


def test_streams(spark, tmp_path):
    folder = f"file://{tmp_path}"
    cache = src.BarCache(spark, f"{folder}/cache")
    days = business_days("2024-01-01", 30)
    bars = bars_of(spark, "A", days, [100 + i % 7 for i in range(30)])
    stamped = bars.withColumn("ingest_ts", F.lit("2024-03-01").cast("timestamp"))
    stamped.write.parquet(f"{folder}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest.upsert_stream(spark.readStream.schema(stamped.schema).parquet(f"{folder}/in"), cache, f"{folder}/cp").awaitTermination()
    assert cache.read().count() == 30 and cache.version() == 1
    for k in range(2):
        bars.where(F.col("session_date").between(F.lit(days[15 * k]), F.lit(days[15 * k + 14]))).coalesce(1).write.parquet(f"{folder}/bars/b={k}")
    source = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/bars/*")
    q = ingest.ema_stream(source, 10).writeStream.format("memory").queryName("emas").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/cp2").start()
    q.awaitTermination()
    got = [r.ema for r in spark.table("emas").orderBy("session_date").collect()]
    want = kernels.ema(np.array([100.0 + i % 7 for i in range(30)]), 10)
    assert got[:9] == [None] * 9 and np.allclose(got[9:], want[9:])


def test_scan_and_research(spark):
    bars = random_walk(spark, ("AAA", "BBB", "CCC"), 420)
    index = random_walk(spark, ("I",), 420, 3).drop("symbol")
    calendar = cal.calendar_table(bars.select("session_date"))
    feats = fts.features(bars, index, calendar, SMALL)
    tables = scan.scan_tables(scan.scan_rows(feats, calendar, None, SMALL))
    every = tables["universe_diagnostics"].collect()
    assert [r.Rank_ID for r in every] == [1, 2, 3] and every[0].Research_Rank_Score >= every[2].Research_Rank_Score
    assert len(tables["universe_diagnostics"].columns) == 41 and all(r.Next_Session_Date is None and r.Execution_Reference is None for r in every)
    grid = research.ema_sensitivity(bars, index, calendar, SMALL, {"fast": (4, 5), "long": (21, 34)}, horizon=5)
    base = {r.cell: r for r in grid.collect()}
    assert base["fast=5"].avg_return_pct == base["long=21"].avg_return_pct
    direct = evs.event_study(feats, calendar, SMALL).agg(F.count("fwd_ret_5d"), F.avg("fwd_ret_5d")).first()
    assert base["fast=5"].n_trades == direct[0] and math.isclose(base["fast=5"].avg_return_pct, direct[1])
    assert research.plateau(grid).first().best in base


def test_sinks_and_config(spark, tmp_path):
    cfg = conf.Config()
    assert len(cfg.hash()) == 16 and cfg.hash() == conf.Config().hash() != SMALL.hash()
    (tmp_path / "c.json").write_text(json.dumps({"ema": {"fast": 8}, "entries": ["A"]}))
    loaded = conf.load_config(str(tmp_path / "c.json"))
    assert loaded.ema.fast == 8 and loaded.entries == ("A",) and conf.load_config(str(tmp_path / "none.json")) == cfg
    (tmp_path / "bad.json").write_text('{"emma": 1}')
    with pytest.raises(ValueError):
        conf.load_config(str(tmp_path / "bad.json"))
    assert conf.classify("ema.fast") == "SOURCE_DERIVED_RULE" and conf.classify("x") == "UNCLASSIFIED" and conf.audit_config(cfg)
    with pytest.raises(ValueError):
        conf.resolve_benchmark(conf.Config(regime=conf.Regime(benchmark="NIFTY200")))
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    assert sinks.content_hash(a) == sinks.content_hash(a.repartition(3).select("b", "a")) != sinks.content_hash(a.distinct())
    m = sinks.manifest(cfg, rows=3)
    assert m["config_hash"] == cfg.hash() and m["rows"] == 3 and m["packages"]["pyspark"]


def test_cli(spark, tmp_path, capsys):
    bars = random_walk(spark, ("AAA", "BBB"), 300)
    bars.write.parquet(f"file://{tmp_path}/data/bars.parquet")
    random_walk(spark, ("I",), 300, 3).write.parquet(f"file://{tmp_path}/data/index_bars.parquet")
    out, data = f"file://{tmp_path}/out", f"file://{tmp_path}/data"
    assert cli.run(["show-config"]) == 0 and json.loads(capsys.readouterr().out)["ema"]["fast"] == 10
    assert cli.run(["scan", "--data", data, "--output-dir", out], spark) == 0
    assert spark.read.parquet(f"{out}/universe_diagnostics.parquet").count() == 2
    assert cli.run(["validate-data", "--data", data, "--output-dir", out], spark) == 0
    window = ["--start", "2018-06-01", "--end", "2019-02-01", "--data", data, "--output-dir", out]
    assert cli.run(["event-study", *window], spark) == 0 and cli.run(["cross-check-data", *window, "--other", data], spark) == 0
    assert cli.run(["backtest", *window, "--exit-rule", "FIXED_HORIZON"], spark) == 0
    assert spark.read.option("header", True).csv(f"{out}/portfolio_equity.csv").count() > 100
