"""Window indicators of one symbol's bars: DataFrame to DataFrame, for df.transform.

All share one partitioning and order (keys, session_date), so a chain of them sorts and shuffles once.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Cluster, Pullback
from ..functions.columns import any_of, by_date, clip, cross_above, cross_below, mean_of, rolling, true

EMAS = ("EMA10", "EMA20", "EMA89", "EMA200")
BULLISH, BEARISH, MIXED = "BULLISH_ALIGNED", "BEARISH_ALIGNED", "MIXED"
#: (weekly, daily) states to labels; fixed values.
MTF = {
    (BULLISH, BULLISH): "FULL_TREND_ALIGNMENT_BULL",
    (BULLISH, MIXED): "WEEKLY_BULL_DAILY_PULLBACK",
    (BULLISH, BEARISH): "WEEKLY_BULL_DAILY_BEAR_COUNTERTREND",
    (BEARISH, BEARISH): "FULL_BEAR_ALIGNMENT",
    (BEARISH, MIXED): "WEEKLY_BEAR_DAILY_PULLBACK",
    (BEARISH, BULLISH): "WEEKLY_BEAR_DAILY_BULL_COUNTERTREND",
    (MIXED, BULLISH): "WEEKLY_MIXED_DAILY_BULL",
    (MIXED, BEARISH): "WEEKLY_MIXED_DAILY_BEAR",
    (MIXED, MIXED): "WEEKLY_MIXED_DAILY_MIXED",
}
CROSS_PAIRS = (("EMA10", "EMA20"), ("EMA20", "EMA89"), ("EMA89", "EMA200"), ("EMA10", "EMA89"), ("EMA10", "EMA200"), ("EMA20", "EMA200"))


def short(name: str) -> str:
    return name.removeprefix("EMA")


def alignment(e: list[Column]) -> Column:
    """State of four averages, fast to slow; null if one is null."""
    up, down = (e[0] > e[1]) & (e[1] > e[2]) & (e[2] > e[3]), (e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3])
    known = e[0].isNotNull() & e[1].isNotNull() & e[2].isNotNull() & e[3].isNotNull()
    return F.when(known, F.when(up, BULLISH).when(down, BEARISH).otherwise(MIXED))


def mtf_state(weekly: Column, daily: Column) -> Column:
    out = F.lit(None).cast("string")
    for (w, d), label in MTF.items():
        out = F.when((weekly == w) & (daily == d), label).otherwise(out)
    return out


def with_alignment(df: DataFrame, suffix: str = "", name: str = "Daily_State") -> DataFrame:
    return df.withColumn(name, alignment([F.col(e + suffix) for e in EMAS]))


def with_crossovers(df: DataFrame, keys=("symbol",)) -> DataFrame:
    w = by_date(*keys)
    out = {}
    for a, b in CROSS_PAIRS:
        out[f"BULL_X_{short(a)}_{short(b)}"] = cross_above(F.col(a), F.col(b), w)
        out[f"BEAR_X_{short(a)}_{short(b)}"] = cross_below(F.col(a), F.col(b), w)
    return df.withColumns(out)


def with_slopes(df: DataFrame, k: int = 10, keys=("symbol",)) -> DataFrame:
    w = by_date(*keys)
    out = {}
    for e in EMAS:
        pct = (F.try_divide(F.col(e), F.lag(e, k).over(w)) - 1) * 100
        out[f"{e}_Slope_Pct_{k}D"], out[f"{e}_Slope_PerDay"] = pct, pct / k
    return df.withColumns(out)


def with_atr_distances(df: DataFrame, atr: str = "ATR14") -> DataFrame:
    out = {"ATR_Pct": F.try_divide(F.col(atr), F.col("close")) * 100}
    return df.withColumns(out | {f"Distance_to_{e}_ATR": F.try_divide(F.col("close") - F.col(e), F.col(atr)) for e in EMAS})


def with_cluster(df: DataFrame) -> DataFrame:
    """Width, centre and bounds of the averages that exist, and distances of neighbours."""
    e = [F.col(x) for x in EMAS]
    df = df.withColumns({"Cluster_Max": F.greatest(*e), "Cluster_Min": F.least(*e), "Cluster_Center": mean_of(e)})
    gaps = [*pairwise(EMAS), (EMAS[0], EMAS[-1])]
    out = {"Cluster_Width_Pct": F.try_divide(F.col("Cluster_Max") - F.col("Cluster_Min"), F.col("close")) * 100}
    return df.withColumns(out | {f"Dist_{a}_{b}_Pct": F.try_divide(F.col(a) - F.col(b), F.col("close")) * 100 for a, b in gaps})


def with_compression(df: DataFrame, c: Cluster = Cluster(), keys=("symbol",)) -> DataFrame:
    """Share of the window's rows at least as wide as now (mode "spec": at most as wide). Rows without a width count in
    the denominator; a row without one scores 0 once the window holds enough widths."""
    frame = by_date(*keys).rowsBetween(1 - c.width_lookback, 0)
    now = F.col("Cluster_Width_Pct")
    seen = F.collect_list("Cluster_Width_Pct").over(frame)
    hits = F.filter("_seen", lambda v: (v >= now) if c.percentile_mode == "coded" else (v <= now))
    df = df.withColumns({"_seen": seen, "_rows": F.count(F.lit(1)).over(frame)})
    share = F.when(F.size("_seen") >= c.percentile_min_periods, F.coalesce(F.size(hits), F.lit(0)) / F.col("_rows"))
    df = df.withColumn("Cluster_Width_Percentile", F.when(now.isNull() & (F.size("_seen") >= c.percentile_min_periods), F.lit(0.0)).otherwise(share)).drop("_seen", "_rows")
    p = F.col("Cluster_Width_Percentile")
    return df.withColumns({"Cluster_Compressed_Flag": true(p <= c.compression_percentile), "Cluster_ExpandedRegime_Flag": true(p >= c.expansion_percentile)})


def with_expansion(df: DataFrame, c: Cluster = Cluster(), keys=("symbol",)) -> DataFrame:
    """Changes and least-squares slope of the width, and EXPANDING, CONTRACTING or FLAT by a rolling band of changes."""
    w = by_date(*keys)
    k, half = c.width_slope_lookback_days, c.flat_band_percentile / 2
    width = F.col("Cluster_Width_Pct")
    df = df.withColumns({"Cluster_Width_Change_1D": width - F.lag(width, 1).over(w), "Cluster_Width_Change_5D": width - F.lag(width, k).over(w), "_no": F.row_number().over(w).cast("double")})
    short_ = w.rowsBetween(1 - k, 0)
    df = df.withColumn("Cluster_Width_Slope", F.when(F.count(width).over(short_) == k, F.regr_slope(width, F.col("_no")).over(short_)))
    long, change = w.rowsBetween(1 - c.width_lookback, 0), F.col("Cluster_Width_Change_5D")
    enough = F.count(change).over(long) >= c.percentile_min_periods
    df = df.withColumns({"_lo": F.when(enough, F.percentile(change, F.lit(0.5 - half)).over(long)), "_hi": F.when(enough, F.percentile(change, F.lit(0.5 + half)).over(long))})
    state = F.when(change > F.col("_hi"), "EXPANDING").when(change < F.col("_lo"), "CONTRACTING").when(change.isNotNull() & F.col("_lo").isNotNull(), "FLAT")
    return df.withColumn("Cluster_Expansion_State", state).drop("_no", "_lo", "_hi")


def with_definitions(df: DataFrame, gap: int = 10, ahead: int = 10, enabled=("A", "B", "C", "D"), keys=("symbol",)) -> DataFrame:
    w = by_date(*keys)
    close, state = F.col("close"), F.col("Daily_State")
    out = {}
    if "A" in enabled:
        near = w.rowsBetween(-gap, 0)
        df = df.withColumn("_x2", F.col("BULL_X_20_89") & true(F.max("BULL_X_10_20").over(near)))
        out["DefA_SequentialCrossover"] = F.col("BULL_X_89_200") & true(F.max("_x2").over(near))
    if "B" in enabled:
        out["DefB_AlignmentTransition"] = turned(state, w)
    if "C" in enabled:
        out["DefC_PriceThroughCluster"] = true((F.lag(close).over(w) <= F.lag("Cluster_Max").over(w)) & (close > F.col("EMA10")) & (close > F.col("EMA20")) & (close > F.col("EMA89")) & (close > F.col("EMA200")))
    if "D" in enabled:
        out["DefD_CompressionExpansion"] = true(F.max("Cluster_Compressed_Flag").over(w.rowsBetween(-ahead, -1)) & (F.col("Cluster_Expansion_State") == "EXPANDING") & (close > F.col("Cluster_Center")))
    return df.withColumns(out).drop("_x2")


def turned(state: Column, w) -> Column:
    """Bullish now and not before; a null state before counts as not bullish."""
    return true(state == BULLISH) & ~F.lag(state).over(w).eqNullSafe(F.lit(BULLISH))


def with_swings(df: DataFrame, left: int = 5, right: int = 5, keys=("symbol",)) -> DataFrame:
    """Pivots that are the only extreme of their window, and what is known of them `right` rows later."""
    w = by_date(*keys)
    around = w.rowsBetween(-left, right)
    full = F.count(F.lit(1)).over(around) == left + right + 1
    last = w.rowsBetween(Window.unboundedPreceding, 0)

    def pivot(price: str, extreme) -> Column:
        values = F.collect_list(price).over(around)
        only = F.size(F.filter(values, lambda v: v == F.col(price))) == 1
        return true(full & (F.col(price) == extreme(price).over(around)) & only)

    df = df.withColumns({"Is_Swing_Low": pivot("low", F.min), "Is_Swing_High": pivot("high", F.max)})
    df = df.withColumns({"_lo": F.when(F.lag("Is_Swing_Low", right).over(w), F.struct(F.lag("low", right).over(w).alias("p"), F.lag("session_date", right).over(w).alias("d"), F.col("session_date").alias("at"))), "_hi": F.when(F.lag("Is_Swing_High", right).over(w), F.lag("high", right).over(w))})
    df = df.withColumns({"_lo": F.last("_lo", ignorenulls=True).over(last), "Swing_High_Stop": F.last("_hi", ignorenulls=True).over(last)})
    return df.withColumns({"Swing_Low_Stop": F.col("_lo.p"), "Confirmed_Swing_Low_Date": F.col("_lo.d"), "Confirmed_Swing_Low_Available_Date": F.col("_lo.at")}).drop("_lo", "_hi")


def swings_as_of(df: DataFrame, as_of: str, right: int = 5, keys=("symbol",)) -> DataFrame:
    """The last swing low and high of each symbol that were confirmed by a date."""
    day = F.lit(as_of).cast("date")
    rows = df.withColumn("_at", F.lead("session_date", right).over(by_date(*keys))).where(F.col("_at") <= day)
    pick = lambda flag, price: F.max(F.when(F.col(flag), F.struct("session_date", F.col(price).alias("price"))))
    out = rows.groupBy(*keys).agg(pick("Is_Swing_Low", "low").alias("l"), pick("Is_Swing_High", "high").alias("h"))
    return out.select(*keys, F.col("l.session_date").alias("swing_low_date"), F.col("l.price").alias("swing_low"), F.col("h.session_date").alias("swing_high_date"), F.col("h.price").alias("swing_high"))


def with_pullback(df: DataFrame, p: Pullback = Pullback(), atr: str = "ATR14", keys=("symbol",)) -> DataFrame:
    """Depth of a close below the centre, in ATR, after a close above it within memory; below EMA200 it is a failure."""
    w = by_date(*keys)
    close, centre = F.col("close"), F.col("Cluster_Center")
    df = df.withColumn("_out", true(F.lag(close).over(w) > F.lag(centre).over(w)))
    inside = F.max("_out").over(w.rowsBetween(1 - p.breakout_memory_bars, 0)) & true(close < centre)
    depth = F.try_divide(centre - close, F.col(atr))
    state = (
        F.when(F.col(atr).isNull() | centre.isNull(), F.lit(None).cast("string")).when(true(inside & (close < F.col("EMA200"))), "TREND_FAILURE")
        .when(inside & (depth <= p.shallow_atr), "SHALLOW_PULLBACK").when(inside & (depth <= p.moderate_atr), "MODERATE_PULLBACK").when(inside & (depth <= p.deep_atr), "DEEP_PULLBACK").otherwise("NO_PULLBACK")
    )
    return df.withColumn("Pullback_State", state).drop("_out")


ENTRIES = {"A": "EntryA_FreshAlignment", "B": "EntryB_ClusterBreakout", "C": "EntryC_PullbackContinuation", "D": "EntryD_SwingHighBreakout", "E": "EntryE_ReclaimAfterPullback"}


def with_entries(df: DataFrame, enabled=tuple(ENTRIES), keys=("symbol",)) -> DataFrame:
    w = by_date(*keys)
    close, state, before = F.col("close"), F.col("Daily_State"), F.lag("Pullback_State").over(w)
    models = {
        "A": turned(state, w),
        "B": cross_above(close, F.col("Cluster_Max"), w),
        "C": true(before.isin("SHALLOW_PULLBACK", "MODERATE_PULLBACK")) & cross_above(close, F.col("EMA20"), w),
        "D": cross_above(close, F.col("Swing_High_Stop"), w) & true(state == BULLISH),
        "E": true(before.isin("SHALLOW_PULLBACK", "MODERATE_PULLBACK", "DEEP_PULLBACK")) & cross_above(close, F.col("Cluster_Center"), w) & ~state.eqNullSafe(F.lit(BEARISH)),
    }
    df = df.withColumns({ENTRIES[k]: models[k] for k in ENTRIES if k in enabled})
    return df.withColumn("Any_Entry_Triggered", any_of([F.col(ENTRIES[k]) for k in ENTRIES if k in enabled]))


def with_stops(df: DataFrame, atr: str = "ATR14", multiple: float = 2.5) -> DataFrame:
    close, low, high, a = F.col("close"), F.col("Swing_Low_Stop"), F.col("Swing_High_Stop"), F.col(atr)
    return df.withColumns({
        "Stop_Distance_Pct_Long": F.try_divide(close - low, close) * 100, "Stop_Distance_ATR_Long": F.try_divide(close - low, a), "ATR_Based_Stop_Long": close - multiple * a,
        "Stop_Distance_Pct_Short": F.try_divide(high - close, close) * 100, "Stop_Distance_ATR_Short": F.try_divide(high - close, a), "ATR_Based_Stop_Short": close + multiple * a,
    })


def with_structure(df: DataFrame, keys=("symbol",)) -> DataFrame:
    rise = F.col("EMA200") - F.lag("EMA200", 5).over(by_date(*keys))
    return df.withColumns({"Price_vs_EMA200": true(F.col("close") > F.col("EMA200")), "EMA89_vs_EMA200": true(F.col("EMA89") > F.col("EMA200")), "EMA200_Rising": true(rise > 0)})


def with_relative_strength(df: DataFrame, windows=(20, 60, 120), keys=("symbol",)) -> DataFrame:
    """Return over the index's return, in percent points; both lagged on the symbol's own rows."""
    w = by_date(*keys)
    back = lambda c, n: F.try_divide(F.col(c), F.lag(c, n).over(w)) - 1
    return df.withColumns({f"RS_{n}D": (back("close", n) - back("index_close", n)) * 100 for n in windows})


def rs_percentile(df: DataFrame, column: str = "RS_60D", by=("session_date",)) -> DataFrame:
    """Average rank over count, in percent, among a date's values that are not null."""
    day = Window.partitionBy(*by)
    tied = F.count(F.lit(1)).over(Window.partitionBy(*by, column))
    rank = F.rank().over(day.orderBy(F.col(column).asc_nulls_last())) + (tied - 1) / 2
    return df.withColumn("RS_Percentile", F.when(F.col(column).isNotNull(), rank / F.count(column).over(day) * 100))


def with_liquidity(df: DataFrame, fast: int = 20, slow: int = 50, keys=("symbol",)) -> DataFrame:
    w = by_date(*keys)
    df = df.withColumns({"Volume20": rolling(F.avg, F.col("volume"), w, fast), "Volume50": rolling(F.avg, F.col("volume"), w, slow), "Traded_Value": F.col("close") * F.col("volume")})
    return df.withColumns({"Volume_Ratio": F.try_divide(F.col("Volume20"), F.col("Volume50")), "Average_Daily_Traded_Value": rolling(F.avg, F.col("Traded_Value"), w, fast)})


def liquid(df: DataFrame, min_price: float = 0.0, min_value: float = 0.0, min_volume: float = 0.0) -> DataFrame:
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.where((none("close") >= min_price) & (none("Average_Daily_Traded_Value") >= min_value) & (none("Volume20") >= min_volume))


def with_signal_state(df: DataFrame) -> DataFrame:
    """One label; each rule outranks those below it, and without a daily state there is none."""
    pb = F.col("Pullback_State")
    bull = true(F.col("Daily_State") == BULLISH)
    state = (
        F.when(F.col("Daily_State").isNull(), F.lit(None).cast("string")).when(F.col("Any_Entry_Triggered"), "ENTRY_TRIGGERED").when(true(pb == "TREND_FAILURE"), "TREND_FAILURE")
        .when(true(pb.isin("SHALLOW_PULLBACK", "MODERATE_PULLBACK", "DEEP_PULLBACK")), "PULLBACK").when(bull & true(F.col("Cluster_Expansion_State") == "EXPANDING"), "BULLISH_CLUSTER").when(bull, "TREND_FORMING").otherwise("WATCH")
    )
    return df.withColumn("Signal_State", state)


def state_changes(df: DataFrame, column: str = "Daily_State", keys=("symbol",)) -> DataFrame:
    before = F.lag(column).over(by_date(*keys))
    return df.withColumn("_was", before).where(F.col("_was").isNotNull() & F.col(column).isNotNull() & (F.col("_was") != F.col(column))).select(*keys, "session_date", F.concat("_was", F.lit(" -> "), column).alias("change"))


def with_scores(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Seven components of 0 to 1 and their weighted mean over those that exist: a ranking aid, not a probability."""
    pick = lambda c, values, other=0.0: F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in values.items()], F.lit(other))
    mtf = F.coalesce("MTF_State", F.lit(""))
    scores = {
        "Trend_Alignment_Score": pick("Daily_State", {BULLISH: 1.0, MIXED: 0.5}),
        "MultiTimeframe_Score": F.when(mtf.startswith("FULL_TREND_ALIGNMENT"), 1.0).when(mtf.contains("PULLBACK"), 0.5).otherwise(0.0),
        "Cluster_Expansion_Score": pick("Cluster_Expansion_State", {"EXPANDING": 1.0, "FLAT": 0.5}),
        "Momentum_Score": clip((F.col("EMA20_Slope_Pct_10D") + 5) / 10, 0, 1),
        "RelativeStrength_Score": clip((F.col("RS_60D") + 10) / 20, 0, 1),
        "Liquidity_Score": clip(F.col("Volume_Ratio"), 0, 2) / 2,
        "Pullback_Quality_Score": pick("Pullback_State", {"SHALLOW_PULLBACK": 1.0, "MODERATE_PULLBACK": 0.6, "DEEP_PULLBACK": 0.2}),
    }
    weights = weights or {k: 1 / len(scores) for k in scores}
    df = df.withColumns(scores)
    total = sum((F.coalesce(F.col(k) * weights.get(k, 0.0), F.lit(0.0)) for k in scores), F.lit(0.0))
    held = sum((F.when(F.col(k).isNotNull(), weights.get(k, 0.0)).otherwise(0.0) for k in scores), F.lit(0.0))
    return df.withColumn("Research_Rank_Score", F.try_divide(total, held))


def signal_reason() -> Column:
    """Sentences that each read one column."""
    daily, weekly, wide, rs, pb = (F.col(c) for c in ("Daily_State", "Weekly_State", "Cluster_Expansion_State", "RS_60D", "Pullback_State"))
    return F.concat_ws(
        " ",
        F.when(daily == BULLISH, "Daily EMA structure is bullish (EMA10>EMA20>EMA89>EMA200).").when(daily == BEARISH, "Daily EMA structure is bearish (EMA10<EMA20<EMA89<EMA200).").otherwise("Daily EMA structure is mixed / not fully aligned."),
        F.when(weekly == BULLISH, "Weekly EMA structure is also bullish.").when(weekly == BEARISH, "Weekly EMA structure is bearish."),
        F.when(wide == "EXPANDING", "EMA cluster width is expanding.").when(wide == "CONTRACTING", "EMA cluster is compressing."),
        F.when(F.col("Price_vs_EMA200"), "Price is above EMA200.").otherwise("Price is below EMA200."),
        F.when(rs.isNotNull(), F.concat(F.lit("60-day relative strength vs index is "), F.when(rs > 0, "positive").otherwise("negative"), F.lit(" ("), F.format_string("%.1f", rs), F.lit("%)."))),
        F.when(pb.isin("SHALLOW_PULLBACK", "MODERATE_PULLBACK"), F.concat(F.lit("Stock is in a "), F.lower(F.replace(pb, F.lit("_"), F.lit(" "))), F.lit(" toward the EMA cluster."))),
        F.when(F.col("EntryD_SwingHighBreakout"), "A confirmed break of the most recent swing high has occurred."),
    )
