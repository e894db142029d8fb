"""Price bases: raw, split adjusted as known at a date, and total return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("RAW", "SPLIT_ADJUSTED", "EXECUTION")


def split_factors(raw: DataFrame, as_of: str | None = None, keys=("symbol",)) -> DataFrame:
    """raw with factor, the product of 1 / ratio of all later splits dated as_of at the latest.

    A running product from the last bar back: linear in the bars."""
    split = F.col("stock_splits")
    counts = split.isNotNull() & (split != 0)
    if as_of:
        counts = counts & (F.col("session_date") <= F.lit(as_of).cast("date"))
    later = Window.partitionBy(*keys).orderBy(F.desc("session_date")).rowsBetween(Window.unboundedPreceding, -1)
    return raw.withColumn("factor", F.coalesce(F.product(F.when(counts, 1 / split)).over(later), F.lit(1.0)))


def adjusted(raw: DataFrame, mode: str = "SPLIT_ADJUSTED", as_of: str | None = None, keys=("symbol",)) -> DataFrame:
    """open, high, low, close times the factor and volume over it; RAW, or raw without a stock_splits column, as it is."""
    if mode not in MODES:
        raise ValueError(f"no such price basis for bars: {mode!r}")
    bars = ("open", "high", "low", "close", "volume")
    if missing := [c for c in bars if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    if mode == "RAW" or "stock_splits" not in raw.columns:
        return raw.select(*keys, "session_date", *bars)
    rows = split_factors(raw, as_of, keys)
    f = F.col("factor")
    return rows.select(*keys, "session_date", *[(F.col(c) * f).alias(c) for c in bars[:4]], F.when(f == 0, F.col("volume")).otherwise(F.col("volume") / f).alias("volume"))


def total_return_close(raw: DataFrame, keys=("symbol",)) -> DataFrame | None:
    return raw.select(*keys, "session_date", F.col("adj_close").alias("total_return_close")) if "adj_close" in raw.columns else None
