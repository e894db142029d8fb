"""Streaming forms of what is incremental: upserts of late bars, weekly bars of an event stream, and averages as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.bars import BarCache


def upsert_stream(rows: DataFrame, cache: BarCache, checkpoint: str) -> StreamingQuery:
    """Raw bars (with ingest_ts) into a cache. Late and corrected bars win by arrival, so a batch that runs twice after
    a failure leaves the same cache."""
    return rows.writeStream.foreachBatch(lambda batch, _: cache.upsert(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_stream(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Weekly counts and values of events (ts, event_type, value) in windows that start on Mondays, closed by watermark."""
    week = F.window("ts", "7 days", startTime="4 days")  # the epoch's first Monday was its fifth day
    out = events.withWatermark("ts", late).groupBy(week, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("high"), F.min("value").alias("low"))
    return out.select(F.col("window.start").cast("date").alias("week"), "event_type", "n", "total", "high", "low")


def ema_stream(bars: DataFrame, period: int) -> DataFrame:
    """A running average of closes for each symbol over micro-batches: sums up to the seed, then the recursion.

    The state is three numbers a symbol. Bars of a batch are taken in order of date; bars must not come later than
    those of a batch before."""
    alpha = 2.0 / (period + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, now = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("session_date", kind="stable")
        out = []
        for date, x in zip(rows["session_date"], rows["close"]):
            n += 1
            if n <= period:
                total += x
                now = total / n
            else:
                now = (x - now) * alpha + now
            out.append((key[0], date, float(now) if n >= period else None))
        state.update((n, float(total), float(now)))
        yield pd.DataFrame(out, columns=["symbol", "session_date", "ema"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, session_date date, ema double", "n long, total double, now double", "append", GroupStateTimeout.NoTimeout)
