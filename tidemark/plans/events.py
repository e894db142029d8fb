"""Event studies anchored at the bar that executes, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Costs
from ..functions.columns import by_date
from ..functions.costs import round_trip_fraction
from ..functions.stats import performance
from ..operators.indicators import ENTRIES

HORIZONS = (1, 3, 5, 10, 20, 40)
REGIMES = ("BULL", "NEUTRAL", "BEAR")


def with_forward(bars: DataFrame, stage: str = "OPEN", horizons=HORIZONS, keys=("symbol",)) -> DataFrame:
    """What follows an entry on each bar: closes at the horizons, extremes of the path and where they stand first.

    An OPEN entry takes part in its own bar: horizon h ends at the close h - 1 rows on, the path starts at once. A CLOSE
    entry starts with the following row. Everything is a window of the bar's own series, computed once for all models."""
    w = by_date(*keys)
    shift = 0 if stage == "OPEN" else 1
    most = max(horizons)
    path = w.rowsBetween(shift, most - 1 + shift)
    df = bars.withColumn("_no", F.row_number().over(w))
    extreme = lambda c, sign: F.max(F.when(F.col(c).isNotNull(), F.struct((F.col(c) * sign).alias("v"), (-F.col("_no")).alias("n")))).over(path)
    df = df.withColumns({f"_fwd_{h}": F.lead("close", h - 1 + shift).over(w) for h in horizons} | {"_high": extreme("high", 1), "_low": extreme("low", -1)})
    return df.withColumns({"_path_high": F.col("_high.v"), "_path_low": -F.col("_low.v"), "_to_high": -F.col("_high.n") - F.col("_no"), "_to_low": -F.col("_low.n") - F.col("_no")}).drop("_high", "_low", "_no")


def event_study(features: DataFrame, calendar: DataFrame, cfg: Config = Config(), scenario: str | None = None, keys=("symbol",)) -> DataFrame:
    """A row for each signal of each entry model that its symbol could execute.

    A signal executes on its symbol's own next row or not at all, so the anchors are read by lead: no join of events to
    bars. The five flags are unpivoted in one pass."""
    model = cfg.execution_model
    stage = "OPEN" if model == "next_open" else "CLOSE"
    w = by_date(*keys)
    hs = cfg.horizons_days
    told = [c for c in ENTRIES.values() if c in features.columns]
    ahead = [f"_fwd_{h}" for h in hs] + ["_path_high", "_path_low", "_to_high", "_to_low", "Market_Regime"]
    rows = with_forward(features, stage, hs, keys)
    price = "open" if model == "next_open" else "close"
    if model == "same_close":
        rows = rows.withColumns({"execution_date": F.col("session_date"), "entry_price": F.col("close"), "_ok": F.col("close").isNotNull()} | {f"x{c}": F.col(c) for c in ahead})
    else:
        due = rows.join(calendar.select("session_date", F.col("next_session").alias("_due")), "session_date", "left")
        rows = due.withColumns({"execution_date": F.lead("session_date").over(w), "entry_price": F.lead(price).over(w)} | {f"x{c}": F.lead(c).over(w) for c in ahead})
        rows = rows.withColumn("_ok", (F.col("execution_date") == F.col("_due")) & F.col("entry_price").isNotNull())
    events = rows.where("_ok").select(*keys, F.col("session_date").alias("signal_date"), "execution_date", "entry_price", *[f"x{c}" for c in ahead], F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in told]))).alias("entry_model"))
    cost = round_trip_fraction(cfg.costs, scenario or cfg.backtest.cost_scenario) * 100
    over = lambda c: (F.try_divide(F.col(c), F.col("entry_price")) - 1) * 100
    label = F.substring_index("entry_model", "_", 1)
    return events.select(
        *keys, "entry_model", F.concat(F.substring(label, 6, 1), F.lit("_"), F.substring_index("entry_model", "_", -1)).alias("entry_model_label"), F.lit(model).alias("execution_model"), "signal_date", "execution_date", "entry_price",
        over("x_path_high").alias("mfe_pct"), over("x_path_low").alias("mae_pct"), F.col("x_to_high").alias("time_to_mfe"), F.col("x_to_low").alias("time_to_mae"), F.col("xMarket_Regime").alias("market_regime"),
        *[over(f"x_fwd_{h}").alias(f"fwd_ret_{h}d") for h in hs], *[(over(f"x_fwd_{h}") - cost).alias(f"fwd_ret_{h}d_net") for h in hs],
    )


def comparison_table(events: DataFrame, horizon: int = 20) -> DataFrame:
    return events.groupBy("entry_model").agg(*performance(F.col(f"fwd_ret_{horizon}d")), *performance(F.col(f"fwd_ret_{horizon}d_net"), "net_"), F.avg("mfe_pct").alias("avg_mfe_pct"), F.avg("mae_pct").alias("avg_mae_pct"))


def regime_breakdown(events: DataFrame, horizon: int = 20) -> DataFrame:
    return events.where(F.col("market_regime").isin(*REGIMES)).groupBy("entry_model", "market_regime").agg(*performance(F.col(f"fwd_ret_{horizon}d")))


def concentration(events: DataFrame) -> DataFrame:
    n = events.groupBy("entry_model", "symbol").agg(F.count(F.lit(1)).alias("n_events"))
    return n.withColumn("share_pct", F.col("n_events") * 100.0 / F.sum("n_events").over(Window.partitionBy("entry_model"))).orderBy("entry_model", F.desc("n_events"), "symbol")


def signal_overlap(features: DataFrame) -> DataFrame:
    """How often two entry models fire on the same bar."""
    told = [c for c in ENTRIES.values() if c in features.columns]
    pairs = [(a, b) for i, a in enumerate(told) for b in told[i + 1 :]]
    sums = features.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    return sums.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "n").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("model_a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("model_b"), "n")


def costs_table(costs: Costs = Costs()) -> list[tuple[str, float, float, float]]:
    from ..functions.costs import SCENARIOS, cost_fraction

    return [(s, cost_fraction(costs, s, "buy"), cost_fraction(costs, s, "sell"), round_trip_fraction(costs, s)) for s in SCENARIOS]
