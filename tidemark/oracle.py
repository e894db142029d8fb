"""The engine's definitions once more in ANSI SQL, for the comparison with another engine."""

from __future__ import annotations

from .operators.indicators import CROSS_PAIRS, EMAS, ENTRIES, MTF, short

PERIODS = {"EMA10": 10, "EMA20": 20, "EMA89": 89, "EMA200": 200}
INDEX_PERIODS = {"Index_EMA20": 20, "Index_EMA50": 50, "Index_EMA89": 89, "Index_EMA200": 200}
SEQ = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
W = "OVER (PARTITION BY symbol ORDER BY session_date)"


def frame(n: int, end: str = "CURRENT ROW") -> str:
    return f"OVER (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN {n} PRECEDING AND {end})"


def bars_sql(name: str, key: str, where: str = "") -> str:
    by = "1, 2" if key else "1"
    first = "first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
    last = "last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
    return f"{name} AS MATERIALIZED (SELECT {key + ', ' if key else ''}session_date, {first} AS open, max(price) AS high, min(price) AS low, {last} AS close, sum(l_quantity) AS volume FROM t {where} GROUP BY {by})"


def recursive_ema(name: str, source: str, periods, value: str = "close") -> str:
    """name (symbol, p, rn, v): the average of each period, from its seed on. source has symbol, rn and the value."""
    listed = ", ".join(f"({p})" for p in periods)
    return f"""{name} AS (
  SELECT symbol, p, CAST(p AS BIGINT) AS rn, v FROM (SELECT symbol, p, avg({value}) AS v, count(*) AS n FROM {source}, (VALUES {listed}) AS x(p) WHERE rn <= p GROUP BY symbol, p) WHERE n = p
  UNION ALL
  SELECT e.symbol, e.p, e.rn + 1, (s.{value} - e.v) * (CAST(2 AS DOUBLE) / (e.p + 1)) + e.v FROM {name} AS e JOIN {source} AS s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"""


def picked(name: str, source: str, recursion: str, columns: dict[str, int]) -> str:
    cols = ", ".join(f"max(v) FILTER (WHERE p = {p}) AS {c}" for c, p in columns.items())
    return f"{name} AS MATERIALIZED (SELECT * FROM {source} LEFT JOIN (SELECT symbol, rn, {cols} FROM {recursion} GROUP BY symbol, rn) USING (symbol, rn))"


def state(a: str, b: str, c: str, d: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {c} IS NULL OR {d} IS NULL THEN NULL WHEN {a} > {b} AND {b} > {c} AND {c} > {d} THEN 'BULLISH_ALIGNED' WHEN {a} < {b} AND {b} < {c} AND {c} < {d} THEN 'BEARISH_ALIGNED' ELSE 'MIXED' END"


def over(a: str, b: str, up: bool = True) -> str:
    x, y = ("<=", ">") if up else (">=", "<")
    return f"coalesce(lag({a}) {W} {x} lag({b}) {W} AND {a} {y} {b}, false)"


_ROW = "session_date, open, high, low, close, volume"
_X = ", ".join(f"{over(a, b)} AS BULL_X_{short(a)}_{short(b)}, {over(a, b, False)} AS BEAR_X_{short(a)}_{short(b)}" for a, b in CROSS_PAIRS)
_MEAN = "(" + " + ".join(f"coalesce({e}, 0)" for e in EMAS) + ") / nullif(" + " + ".join(f"CAST({e} IS NOT NULL AS INT)" for e in EMAS) + ", 0)"
_MTF = "CASE " + " ".join(f"WHEN Weekly_State = '{w}' AND Daily_State = '{d}' THEN '{x}'" for (w, d), x in MTF.items()) + " END"
_SLOPES = ", ".join(f"({e} / lag({e}, 10) {W} - 1) * 100 AS {e}_Slope_Pct_10D, ({e} / lag({e}, 10) {W} - 1) * 100 / 10 AS {e}_Slope_PerDay" for e in EMAS)
_TURNED = f"coalesce(Daily_State = 'BULLISH_ALIGNED', false) AND lag(Daily_State) {W} IS DISTINCT FROM 'BULLISH_ALIGNED'"
_AROUND = "OVER (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"

#: Common table expressions, each on those before it.
STEPS = [
    f"t AS MATERIALIZED (SELECT c_mktsegment AS symbol, CAST(l_shipdate AS DATE) AS session_date, l_extendedprice / l_quantity AS price, l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)",
    bars_sql("bars", "symbol"),
    bars_sql("index_bars", ""),
    """cal AS MATERIALIZED (SELECT session_date, row_number() OVER (ORDER BY session_date) AS session_no, lead(session_date) OVER (ORDER BY session_date) AS next_session, lag(session_date) OVER (ORDER BY session_date) AS prev_session,
  CAST(date_trunc('week', session_date) AS DATE) AS week, max(session_date) OVER (PARTITION BY date_trunc('week', session_date)) AS expected_week_end FROM (SELECT DISTINCT session_date FROM bars))""",
    f"b AS MATERIALIZED (SELECT symbol, {_ROW}, row_number() {W} AS rn, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS tr FROM bars)",
    recursive_ema("e", "b", PERIODS.values()),
    picked("d0", "b", "e", PERIODS),
    "a AS (SELECT symbol, rn, tr AS y FROM b WHERE rn = 1 UNION ALL SELECT a.symbol, a.rn + 1, (1 - CAST(1 AS DOUBLE) / 14) * a.y + CAST(1 AS DOUBLE) / 14 * b.tr FROM a JOIN b ON b.symbol = a.symbol AND b.rn = a.rn + 1)",
    "d1 AS MATERIALIZED (SELECT d0.*, CASE WHEN rn >= 14 THEN y END AS ATR14 FROM d0 JOIN a USING (symbol, rn))",
    # weekly bars and their averages
    """weekly AS MATERIALIZED (SELECT symbol, week, open, high, low, close, volume, week_end, greatest(week_end, due) AS expected_week_end, row_number() OVER (PARTITION BY symbol ORDER BY week) AS rn FROM (
  SELECT symbol, CAST(date_trunc('week', session_date) AS DATE) AS week, arg_min(open, session_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, session_date) AS close, sum(volume) AS volume, max(session_date) AS week_end FROM bars GROUP BY 1, 2)
  JOIN (SELECT week, max(session_date) AS due FROM cal GROUP BY 1) USING (week))""",
    recursive_ema("we", "weekly", PERIODS.values()),
    picked("w", "weekly", "we", {f"{k}_W": p for k, p in PERIODS.items()}),
    # the index
    "ib AS MATERIALIZED (SELECT 'index' AS symbol, session_date, close, row_number() OVER (ORDER BY session_date) AS rn FROM index_bars)",
    recursive_ema("ie", "ib", INDEX_PERIODS.values()),
    picked("ix", "ib", "ie", INDEX_PERIODS),
    "regime AS MATERIALIZED (SELECT session_date, close AS index_close, Index_EMA20, Index_EMA50, Index_EMA89, Index_EMA200, CASE WHEN Index_EMA200 IS NULL THEN NULL WHEN close > Index_EMA50 AND Index_EMA50 > Index_EMA200 THEN 'BULL' WHEN close < Index_EMA50 AND Index_EMA50 < Index_EMA200 THEN 'BEAR' ELSE 'NEUTRAL' END AS Market_Regime FROM ix)",
    # as-of joins
    """d2 AS MATERIALIZED (SELECT d1.*, w.week_end AS Weekly_Period_End, w.EMA10_W, w.EMA20_W, w.EMA89_W, w.EMA200_W, w.expected_week_end AS Weekly_Availability_Date, r.Market_Regime, r.index_close
  FROM d1 ASOF LEFT JOIN w ON d1.symbol = w.symbol AND d1.session_date >= w.expected_week_end ASOF LEFT JOIN regime AS r ON d1.session_date >= r.session_date)""",
    f"""d3 AS MATERIALIZED (SELECT *, {_X}, {state(*EMAS)} AS Daily_State, {state(*[x + "_W" for x in EMAS])} AS Weekly_State, greatest({", ".join(EMAS)}) AS Cluster_Max, least({", ".join(EMAS)}) AS Cluster_Min, {_MEAN} AS Cluster_Center,
  (greatest({", ".join(EMAS)}) - least({", ".join(EMAS)})) / close * 100 AS Cluster_Width_Pct FROM d2)""",
    f"""d4 AS MATERIALIZED (SELECT *, {_MTF} AS MTF_State, list(Cluster_Width_Pct) {frame(251)} AS seen, count(*) {frame(251)} AS held, count(Cluster_Width_Pct) {frame(251)} AS wide,
  Cluster_Width_Pct - lag(Cluster_Width_Pct, 1) {W} AS Cluster_Width_Change_1D, Cluster_Width_Pct - lag(Cluster_Width_Pct, 5) {W} AS Cluster_Width_Change_5D,
  CASE WHEN count(Cluster_Width_Pct) {frame(4)} = 5 THEN regr_slope(Cluster_Width_Pct, rn) {frame(4)} END AS Cluster_Width_Slope FROM d3)""",
    f"""d5 AS MATERIALIZED (SELECT * EXCLUDE (seen), CASE WHEN wide >= 30 THEN coalesce(CAST(len(list_filter(seen, lambda v: v >= Cluster_Width_Pct)) AS DOUBLE), 0) / held END AS Cluster_Width_Percentile,
  CASE WHEN count(Cluster_Width_Change_5D) {frame(251)} >= 30 THEN quantile_cont(Cluster_Width_Change_5D, 0.45) {frame(251)} END AS lo, CASE WHEN count(Cluster_Width_Change_5D) {frame(251)} >= 30 THEN quantile_cont(Cluster_Width_Change_5D, 0.55) {frame(251)} END AS hi FROM d4)""",
    f"""d6 AS MATERIALIZED (SELECT *, coalesce(Cluster_Width_Percentile <= 0.2, false) AS Cluster_Compressed_Flag, coalesce(Cluster_Width_Percentile >= 0.8, false) AS Cluster_ExpandedRegime_Flag,
  CASE WHEN Cluster_Width_Change_5D IS NULL OR lo IS NULL THEN NULL WHEN Cluster_Width_Change_5D > hi THEN 'EXPANDING' WHEN Cluster_Width_Change_5D < lo THEN 'CONTRACTING' ELSE 'FLAT' END AS Cluster_Expansion_State, {_SLOPES},
  BULL_X_20_89 AND coalesce(max(BULL_X_10_20) {frame(10)}, false) AS x2, coalesce(lag(close) {W} > lag(Cluster_Center) {W}, false) AS was_out FROM d5)""",
    f"""d7 AS MATERIALIZED (SELECT *, BULL_X_89_200 AND coalesce(max(x2) {frame(10)}, false) AS DefA_SequentialCrossover, {_TURNED} AS DefB_AlignmentTransition,
  coalesce(lag(close) {W} <= lag(Cluster_Max) {W} AND close > EMA10 AND close > EMA20 AND close > EMA89 AND close > EMA200, false) AS DefC_PriceThroughCluster,
  coalesce(max(Cluster_Compressed_Flag) {frame(10, "1 PRECEDING")} AND Cluster_Expansion_State = 'EXPANDING' AND close > Cluster_Center, false) AS DefD_CompressionExpansion,
  count(*) {_AROUND} = 11 AND low = min(low) {_AROUND} AND len(list_filter(list(low) {_AROUND}, lambda v: v = low)) = 1 AS Is_Swing_Low, count(*) {_AROUND} = 11 AND high = max(high) {_AROUND} AND len(list_filter(list(high) {_AROUND}, lambda v: v = high)) = 1 AS Is_Swing_High,
  max(was_out) {frame(59)} AND coalesce(close < Cluster_Center, false) AS in_pb FROM d6)""",
    f"""d8 AS MATERIALIZED (SELECT *, CASE WHEN lag(Is_Swing_Low, 5) {W} THEN lag(low, 5) {W} END AS sl, CASE WHEN lag(Is_Swing_Low, 5) {W} THEN lag(session_date, 5) {W} END AS sld, CASE WHEN lag(Is_Swing_Low, 5) {W} THEN session_date END AS sla, CASE WHEN lag(Is_Swing_High, 5) {W} THEN lag(high, 5) {W} END AS sh,
  CASE WHEN ATR14 IS NULL OR Cluster_Center IS NULL THEN NULL WHEN in_pb AND coalesce(close < EMA200, false) THEN 'TREND_FAILURE' WHEN in_pb AND (Cluster_Center - close) / ATR14 <= 1.0 THEN 'SHALLOW_PULLBACK' WHEN in_pb AND (Cluster_Center - close) / ATR14 <= 2.5 THEN 'MODERATE_PULLBACK' WHEN in_pb AND (Cluster_Center - close) / ATR14 <= 4.0 THEN 'DEEP_PULLBACK' ELSE 'NO_PULLBACK' END AS Pullback_State FROM d7)""",
    f"d9 AS MATERIALIZED (SELECT *, last_value(sl IGNORE NULLS) {W} AS Swing_Low_Stop, last_value(sld IGNORE NULLS) {W} AS Confirmed_Swing_Low_Date, last_value(sla IGNORE NULLS) {W} AS Confirmed_Swing_Low_Available_Date, last_value(sh IGNORE NULLS) {W} AS Swing_High_Stop FROM d8)",
    f"""d10 AS MATERIALIZED (SELECT *, {_TURNED} AS EntryA_FreshAlignment, {over("close", "Cluster_Max")} AS EntryB_ClusterBreakout, coalesce(lag(Pullback_State) {W} IN ('SHALLOW_PULLBACK', 'MODERATE_PULLBACK'), false) AND {over("close", "EMA20")} AS EntryC_PullbackContinuation,
  {over("close", "Swing_High_Stop")} AND coalesce(Daily_State = 'BULLISH_ALIGNED', false) AS EntryD_SwingHighBreakout,
  coalesce(lag(Pullback_State) {W} IN ('SHALLOW_PULLBACK', 'MODERATE_PULLBACK', 'DEEP_PULLBACK'), false) AND {over("close", "Cluster_Center")} AND Daily_State IS DISTINCT FROM 'BEARISH_ALIGNED' AS EntryE_ReclaimAfterPullback,
  (close / lag(close, 20) {W} - index_close / lag(index_close, 20) {W}) * 100 AS RS_20D, (close / lag(close, 60) {W} - index_close / lag(index_close, 60) {W}) * 100 AS RS_60D, (close / lag(close, 120) {W} - index_close / lag(index_close, 120) {W}) * 100 AS RS_120D,
  CASE WHEN count(volume) {frame(19)} = 20 THEN avg(volume) {frame(19)} END AS Volume20, CASE WHEN count(volume) {frame(49)} = 50 THEN avg(volume) {frame(49)} END AS Volume50, close * volume AS Traded_Value, CASE WHEN count(volume) {frame(19)} = 20 THEN avg(close * volume) {frame(19)} END AS Average_Daily_Traded_Value,
  coalesce(close > EMA200, false) AS Price_vs_EMA200, coalesce(EMA89 > EMA200, false) AS EMA89_vs_EMA200, coalesce(EMA200 - lag(EMA200, 5) {W} > 0, false) AS EMA200_Rising FROM d9)""",
    f"""d11 AS MATERIALIZED (SELECT *, Volume20 / Volume50 AS Volume_Ratio, {" OR ".join(ENTRIES.values())} AS Any_Entry_Triggered, cal.next_session AS due, lead(d10.session_date) OVER (PARTITION BY symbol ORDER BY d10.session_date) AS nxt FROM d10 JOIN (SELECT session_date AS sd, next_session FROM cal) AS cal ON d10.session_date = cal.sd)""",
    """f AS MATERIALIZED (SELECT *, CASE WHEN Daily_State IS NULL THEN NULL WHEN Any_Entry_Triggered THEN 'ENTRY_TRIGGERED' WHEN Pullback_State = 'TREND_FAILURE' THEN 'TREND_FAILURE' WHEN Pullback_State IN ('SHALLOW_PULLBACK', 'MODERATE_PULLBACK', 'DEEP_PULLBACK') THEN 'PULLBACK'
  WHEN Daily_State = 'BULLISH_ALIGNED' AND Cluster_Expansion_State = 'EXPANDING' THEN 'BULLISH_CLUSTER' WHEN Daily_State = 'BULLISH_ALIGNED' THEN 'TREND_FORMING' ELSE 'WATCH' END AS Signal_State,
  CASE Daily_State WHEN 'BULLISH_ALIGNED' THEN 1.0 WHEN 'MIXED' THEN 0.5 ELSE 0.0 END AS s1, CASE WHEN MTF_State LIKE 'FULL_TREND_ALIGNMENT%' THEN 1.0 WHEN MTF_State LIKE '%PULLBACK%' THEN 0.5 ELSE 0.0 END AS s2, CASE Cluster_Expansion_State WHEN 'EXPANDING' THEN 1.0 WHEN 'FLAT' THEN 0.5 ELSE 0.0 END AS s3,
  CASE WHEN EMA20_Slope_Pct_10D IS NOT NULL THEN greatest(0, least(1, (EMA20_Slope_Pct_10D + 5) / 10)) END AS s4, CASE WHEN RS_60D IS NOT NULL THEN greatest(0, least(1, (RS_60D + 10) / 20)) END AS s5, CASE WHEN Volume_Ratio IS NOT NULL THEN greatest(0, least(2, Volume_Ratio)) / 2 END AS s6,
  CASE Pullback_State WHEN 'SHALLOW_PULLBACK' THEN 1.0 WHEN 'MODERATE_PULLBACK' THEN 0.6 WHEN 'DEEP_PULLBACK' THEN 0.2 ELSE 0.0 END AS s7 FROM d11)""",
    """scored AS MATERIALIZED (SELECT *, (CAST(s1 AS DOUBLE) + s2 + s3 + coalesce(s4, 0) + coalesce(s5, 0) + coalesce(s6, 0) + s7) / (4 + CAST(s4 IS NOT NULL AS INT) + CAST(s5 IS NOT NULL AS INT) + CAST(s6 IS NOT NULL AS INT)) AS score,
  CASE WHEN RS_60D IS NOT NULL THEN (rank() OVER (PARTITION BY session_date ORDER BY RS_60D NULLS LAST) + (count(*) OVER (PARTITION BY session_date, RS_60D) - 1) / 2.0) / count(RS_60D) OVER (PARTITION BY session_date) * 100 END AS RS_Percentile,
  nullif(concat_ws(', ', CASE WHEN EntryA_FreshAlignment THEN 'A_FreshAlignment' END, CASE WHEN EntryB_ClusterBreakout THEN 'B_ClusterBreakout' END, CASE WHEN EntryC_PullbackContinuation THEN 'C_PullbackContinuation' END, CASE WHEN EntryD_SwingHighBreakout THEN 'D_SwingHighBreakout' END, CASE WHEN EntryE_ReclaimAfterPullback THEN 'E_ReclaimAfterPullback' END), '') AS told FROM f)""",
]


def steps(periods: dict[str, int]) -> list[str]:
    """STEPS with other periods behind the names of the daily and weekly averages."""
    swap = lambda of: [recursive_ema("e", "b", of.values()), picked("d0", "b", "e", of), recursive_ema("we", "weekly", of.values()), picked("w", "weekly", "we", {f"{k}_W": p for k, p in of.items()})]
    other = dict(zip(swap(PERIODS), swap(periods)))
    return [other.get(x, x) for x in STEPS]


def cells_sql(cells: list[tuple], horizon: int = 20) -> str:
    """n_trades and avg_return_pct of cells (cell, perturbed_param, and four periods), each from its own features and events."""
    one = []
    for cell, parameter, *periods in cells:
        names = dict(zip(PERIODS, periods))
        inner = "WITH RECURSIVE " + ",\n".join([*steps(names), *events_sql("OPEN")]) + f" SELECT count(fwd_ret_{horizon}d) AS n, avg(fwd_ret_{horizon}d) AS r FROM ev"
        told = ", ".join(f"CAST({n} AS BIGINT) AS {k}" for k, n in zip(("fast", "medium", "structural", "long"), periods))
        one.append(f"SELECT '{cell}' AS cell, '{parameter}' AS perturbed_param, {told}, n AS n_trades, round(r, 6) AS avg_return_pct FROM ({inner})")
    return " UNION ALL ".join(one)


def forward(stage: str, horizons=(1, 3, 5, 10, 20, 40), source: str = "f", part: str = "symbol") -> str:
    """fw: source with what follows an entry on each row."""
    s = 0 if stage == "OPEN" else 1
    w = f"OVER (PARTITION BY {part} ORDER BY session_date)"
    path = f"OVER (PARTITION BY {part} ORDER BY session_date ROWS BETWEEN {s} FOLLOWING AND {max(horizons) - 1 + s} FOLLOWING)"
    leads = ", ".join(f"lead(close, {h - 1 + s}) {w} AS fwd_{h}" for h in horizons)
    return f"fw AS MATERIALIZED (SELECT *, {leads}, max(high) {path} AS ph, min(low) {path} AS pl, arg_max(rk, high * 1e6 * 0 + high) {path} - rk AS th, arg_min(rk, low) {path} - rk AS tl FROM (SELECT *, row_number() {w} AS rk FROM {source}))"


def events_sql(stage: str = "OPEN", source: str = "f", part: str = "symbol", horizons=(1, 3, 5, 10, 20, 40)) -> list[str]:
    """fw and ev: the events of a next_open (OPEN) or next_close (CLOSE) study."""
    from .functions.costs import round_trip_fraction

    w = f"OVER (PARTITION BY {part} ORDER BY session_date)"
    price = "open" if stage == "OPEN" else "close"
    ahead = ["ph", "pl", "th", "tl", "Market_Regime", *[f"fwd_{h}" for h in horizons]]
    moved = f"mv AS MATERIALIZED (SELECT {part}, session_date AS signal_date, due, lead(session_date) {w} AS execution_date, lead({price}) {w} AS entry_price, {', '.join(f'lead({c}) {w} AS x_{c}' for c in ahead)}, {', '.join(ENTRIES.values())} FROM fw)"
    cost = round_trip_fraction() * 100
    models = " UNION ALL ".join(f"SELECT *, '{m}' AS entry_model, '{m[5]}_{m[7:]}' AS entry_model_label FROM mv WHERE {m} AND execution_date = due AND entry_price IS NOT NULL" for m in ENTRIES.values())
    pct = lambda c: f"(x_{c} / entry_price - 1) * 100"
    cols = ", ".join([f"{pct('ph')} AS mfe_pct, {pct('pl')} AS mae_pct, x_th AS time_to_mfe, x_tl AS time_to_mae, x_Market_Regime AS market_regime", *[f"{pct(f'fwd_{h}')} AS fwd_ret_{h}d" for h in horizons], *[f"{pct(f'fwd_{h}')} - {cost!r} AS fwd_ret_{h}d_net" for h in horizons]])
    return [forward(stage, horizons, source, part), moved, f"ev AS MATERIALIZED (SELECT {part}, entry_model, entry_model_label, signal_date, execution_date, entry_price, {cols} FROM ({models}))"]


def stats_sql(r: str, prefix: str = "") -> str:
    """The aggregates of functions.stats.performance, rounded."""
    v = {
        "n_trades": f"count({r})", "win_rate_pct": f"round(count({r}) FILTER (WHERE {r} > 0) * 100.0 / nullif(count({r}), 0), 6)", "avg_return_pct": f"round(avg({r}), 6)", "median_return_pct": f"round(median({r}), 6)", "std_return_pct": f"round(stddev_samp({r}), 6)",
        "profit_factor": f"round(CASE WHEN -sum({r}) FILTER (WHERE {r} <= 0) > 0 THEN coalesce(sum({r}) FILTER (WHERE {r} > 0), 0) / -sum({r}) FILTER (WHERE {r} <= 0) END, 6)", "expectancy_pct": f"round(avg({r}), 6)", "avg_win_pct": f"round(avg({r}) FILTER (WHERE {r} > 0), 6)",
        "avg_loss_pct": f"round(avg({r}) FILTER (WHERE {r} <= 0), 6)", "best_trade_pct": f"round(max({r}), 6)", "worst_trade_pct": f"round(min({r}), 6)", "skew": f"round(CASE WHEN count({r}) > 2 THEN skewness({r}) END, 6)",
    }
    return ", ".join(f"{x} AS {prefix}{k}" for k, x in v.items())


def sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([*STEPS, *more]) + "\n" + select
