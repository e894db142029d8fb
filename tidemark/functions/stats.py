"""Statistics of returns and equity curves; bootstraps are in a module of their own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bootstrap import cluster_bootstrap, two_way_bootstrap  # noqa: F401

STATS = ("n_trades", "win_rate_pct", "avg_return_pct", "median_return_pct", "std_return_pct", "profit_factor", "expectancy_pct", "avg_win_pct", "avg_loss_pct", "best_trade_pct", "worst_trade_pct", "skew")


def performance(r: Column, prefix: str = "") -> list[Column]:
    """Aggregates of returns; nulls count for nothing, all but n_trades are null without a return. A loss is r <= 0."""
    n = F.count(r)
    win, loss = F.when(r > 0, r), F.when(r <= 0, r)
    lost = -F.sum(loss)
    skew = F.when(n > 2, F.try_divide(F.skewness(r) * F.sqrt(n * (n - 1)), n - 2))
    values = [n, F.try_divide(F.count(win) * 100.0, n), F.avg(r), F.median(r), F.stddev_samp(r), F.when(lost > 0, F.coalesce(F.sum(win), F.lit(0.0)) / lost), F.avg(r), F.avg(win), F.avg(loss), F.max(r), F.min(r), skew]
    return [v.alias(prefix + name) for v, name in zip(values, STATS)]


def performance_by(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """Rows with a null group are left out."""
    for g in groups:
        df = df.where(F.col(g).isNotNull())
    return df.groupBy(*groups).agg(*performance(F.col(column)))


def portfolio_stats(equity: DataFrame, trades: DataFrame | None = None, risk_free: float = 0.0, mar: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each curve of equity (session_date, equity, positions_value)."""
    part = [F.col(k) for k in keys] or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy("session_date")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = equity.withColumns({"_ret": F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1, "_dd": (F.try_divide(F.col("equity"), F.max("equity").over(to_here)) - 1) * 100})
    rows = rows.withColumn("_under", (F.col("_dd") < -1e-9).cast("int"))
    rows = rows.withColumn("_island", F.sum(1 - F.col("_under")).over(to_here))
    rows = rows.withColumn("_run", F.sum("_under").over(Window.partitionBy(*part, "_island")))
    down = F.when(F.col("_ret") < mar / 252, F.col("_ret"))
    days = F.datediff(F.max("session_date"), F.min("session_date"))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.when(days > 0, days / 365.25).alias("_years"), F.avg("_ret").alias("_mean"), F.stddev_samp("_ret").alias("_std"), F.stddev_samp(down).alias("_down"),
        F.min("_dd").alias("max_drawdown_pct"), F.max("_run").cast("long").alias("max_drawdown_duration_sessions"), (F.avg(F.try_divide("positions_value", "equity")) * 100).alias("avg_exposure_pct"),
        F.max_by("equity", "session_date").alias("final_equity"), F.min_by("equity", "session_date").alias("initial_equity"), F.avg("equity").alias("_avg"),
    )
    year = F.lit(float(np.sqrt(252)))
    out = out.withColumns({
        "cagr_pct": F.when((F.col("initial_equity") > 0) & (F.col("final_equity") >= 0), (F.pow(F.col("final_equity") / F.col("initial_equity"), F.try_divide(F.lit(1.0), F.col("_years"))) - 1) * 100),
        "annualized_volatility_pct": F.col("_std") * year * 100,
        "sharpe": F.when(F.col("_std") > 0, (F.col("_mean") * 252 - risk_free) / (F.col("_std") * year)),
        "sortino": F.when(F.col("_down") > 0, (F.col("_mean") * 252 - mar) / (F.col("_down") * year)),
        "risk_free_rate_annual": F.lit(risk_free), "mar_annual": F.lit(mar),
    })
    out = out.withColumn("calmar", F.when(F.col("max_drawdown_pct") < 0, F.col("cagr_pct") / F.abs("max_drawdown_pct")))
    if trades is not None:
        p = F.col("net_pnl")
        lost = -F.sum(F.when(p <= 0, p))
        sums = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("trade_count"), F.try_divide(F.count(F.when(p > 0, 1)) * 100.0, F.count(F.lit(1))).alias("win_rate_pct"), F.when(lost > 0, F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)) / lost).alias("profit_factor"), F.avg(p).alias("expectancy_per_trade"), F.sum(F.abs(F.col("entry_price") * F.col("quantity"))).alias("_notional"))
        out = out.join(sums, list(keys), "left") if keys else out.crossJoin(F.broadcast(sums))  # one row each
        out = out.withColumns({"trade_frequency_per_year": F.try_divide("trade_count", "_years"), "notional_turnover_pct": F.try_divide(F.col("_notional") * 100, F.col("_avg"))}).drop("_notional")
    return out.drop("_years", "_mean", "_std", "_down", "_avg")
