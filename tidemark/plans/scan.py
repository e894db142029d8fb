"""The daily scan: one row for each symbol on the analysis date, ranked, as candidates or signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.costs import geometry_ok
from ..operators import indicators as ind
from ..operators.joins import with_execution

CANDIDATE_STATES = ("WATCH", "TREND_FORMING", "BULLISH_CLUSTER", "PULLBACK")
LABELS = {"EntryA_FreshAlignment": "A_FreshAlignment", "EntryB_ClusterBreakout": "B_ClusterBreakout", "EntryC_PullbackContinuation": "C_PullbackContinuation", "EntryD_SwingHighBreakout": "D_SwingHighBreakout", "EntryE_ReclaimAfterPullback": "E_ReclaimAfterPullback"}


def scan_rows(features: DataFrame, calendar: DataFrame, analysis_date: str | None, cfg: Config = Config(), quality: DataFrame | None = None, universe: DataFrame | None = None) -> DataFrame:
    """The exported columns and the flags that route a row. analysis_date None: each symbol's last bar.

    Rows of the date alone leave the window stage, so what follows is as small as the universe."""
    model = cfg.execution_model
    d = with_execution(features, calendar, model)
    if analysis_date is None:
        d = d.withColumn("_last", F.max("session_date").over(Window.partitionBy("symbol"))).where("session_date = _last").drop("_last")
    else:
        d = d.where(F.col("session_date") == F.lit(analysis_date).cast("date"))
    d = ind.with_scores(ind.rs_percentile(d))
    if quality is None:
        d = d.withColumns({"Data_Quality": F.lit(None).cast("string"), "Eligible_For_Signal": F.lit(True)})
    else:
        d = d.join(quality.select("symbol", F.col("status").alias("Data_Quality"), F.col("eligible").alias("Eligible_For_Signal")), "symbol", "left")
    if universe is None:
        d = d.withColumn("Company", F.lit(None).cast("string"))
    else:
        d = d.join(universe.select("symbol", F.col("company").alias("Company")), "symbol")
    told = F.concat_ws(", ", *[F.when(F.col(c), label) for c, label in LABELS.items() if c in features.columns])
    stop = F.col("Swing_Low_Stop")
    names = {
        "Symbol": "symbol", "Company": "Company", "Analysis_Date": "session_date", "Signal_State": "Signal_State", "Daily_EMA10": "EMA10", "Daily_EMA20": "EMA20", "Daily_EMA89": "EMA89", "Daily_EMA200": "EMA200",
        "Daily_Alignment": "Daily_State", "Weekly_EMA10": "EMA10_W", "Weekly_EMA20": "EMA20_W", "Weekly_EMA89": "EMA89_W", "Weekly_EMA200": "EMA200_W", "Weekly_Alignment": "Weekly_State",
    }
    same = ["MTF_State", "Cluster_Width_Pct", "Cluster_Expansion_State", "EMA20_Slope_Pct_10D", "ATR14", "ATR_Pct", "RS_20D", "RS_60D", "RS_120D", "RS_Percentile", "Market_Regime", "Pullback_State"]
    return d.select(
        *[F.col(v).alias(k) for k, v in names.items()], *same, F.col("Swing_High_Stop").alias("Confirmed_Swing_High"), stop.alias("Confirmed_Swing_Low"), F.nullif(told, F.lit("")).alias("Entry_Models_Triggered"),
        F.col("close").alias("Signal_Close"), F.lit(model).alias("Execution_Model"), F.col("execution_date").alias("Next_Session_Date"), F.when(F.col("execution_status") == "OK", F.col("execution_price")).alias("Execution_Reference"),
        stop.alias("Stop_Reference"), F.col("Stop_Distance_Pct_Long").alias("Stop_Distance_Pct"), F.when(stop.isNotNull() & F.col("close").isNotNull(), geometry_ok(F.col("close"), stop)).alias("Risk_Geometry_Valid"),
        "Data_Quality", "Eligible_For_Signal", "Research_Rank_Score", ind.signal_reason().alias("Signal_Reason"), (F.length(told) > 0).alias("_has_entry_trigger"),
    )


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with Rank_ID by score, best first; equal scores by symbol. A scan has a row for each symbol of a universe."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("Research_Rank_Score"), "Symbol")
    return rows.select(F.row_number().over(order).alias("Rank_ID"), "*")


def scan_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """universe_diagnostics, signals and candidates; TREND_FAILURE and stateless rows are in neither of the last two."""
    every = ranked(rows)
    return {
        "universe_diagnostics": every.drop("_has_entry_trigger"),
        "signals": every.where("_has_entry_trigger").drop("_has_entry_trigger"),
        "candidates": every.where(~F.col("_has_entry_trigger") & F.col("Signal_State").isin(*CANDIDATE_STATES)).drop("_has_entry_trigger"),
    }


def first_symbols(universe: DataFrame, n: int) -> DataFrame:
    return universe.orderBy("symbol").limit(n)
