"""Weekly bars of a stream of daily ones, complete when the calendar says so.

A week is told once the clock has passed the last session that the calendar schedules for it, not once bars stop coming:
a Friday's bar doesn't end a week that has a session on Sunday. The clock is the watermark on ingest_ts, stamped when a row
arrives, so bars of past sessions and corrections are never too late; only a stamp that lies further behind the largest
one than `late` is passed over by Spark, so `late` must bound how far stamps get out of order. Each (symbol, week) keeps its bars by date in a map
state, at most seven, and has a timer at its due time. What arrives after a week was told reopens it: the week is told
again with the next revision. Of bars of one date the one that arrived last counts, so input may be shuffled and
repeated.

As in batch, first and last pass over nulls, and a week without one of open, high, low and close isn't told. State goes
`keep` days after a week is due; what comes later still begins that week anew. A lost executor's state is restored from the
checkpoint; the query needs the RocksDB state store (see PROVIDER).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.calendar import week_of

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
VALUES = ("open", "high", "low", "close", "volume")
TOLD = "symbol string, week date, open double, high double, low double, close double, volume double, week_end date, expected_week_end date, revision int"


def _rank(bar: tuple) -> tuple:
    """The later bar wins, then the greater one, as in the cache."""
    return bar[-1], [(x is not None, x or 0.0) for x in bar[:-1]]


class _Weeks(StatefulProcessor):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "session_date date", ", ".join(f"{v} double" for v in VALUES) + ", ingest_ts timestamp")
        self.week = handle.getValueState("week", "expected date, due long, revision int, gone long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.week.get() if self.week.exists() else None
        expected, due, revision, gone = state or (None, None, 0, None)
        changed = False
        for frame in rows:
            for r in frame.sort_values("ingest_ts", kind="stable").itertuples(index=False):
                day, bar = (r.session_date,), (*[None if pd.isna(x) else float(x) for x in (getattr(r, v) for v in VALUES)], r.ingest_ts)
                if self.bars.containsKey(day) and _rank(self.bars.getValue(day)) >= _rank(bar):
                    continue
                self.bars.updateValue(day, bar)
                changed = True
                # the calendar's last session, or a bar beyond it
                last = max(x for x in (expected, r.expected_week_end, r.session_date) if x is not None and not pd.isna(x))
                if last != expected:
                    expected, due = last, int((pd.Timestamp(last) + timedelta(days=1)).timestamp() * 1000)
                    self.handle.registerTimer(due)
        if not changed:
            return
        if gone is None:
            gone = max(due, timerValues.getCurrentWatermarkInMs()) + self.keep * 86_400_000
            self.handle.registerTimer(gone)
        ripe = timerValues.getCurrentWatermarkInMs() >= due
        self.week.update((expected, due, revision + ripe, gone))
        if ripe:
            yield from self.told(key, expected, revision + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.week.exists():
            return
        expected, due, revision, gone = self.week.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if now >= gone:
            self.bars.clear()
            self.week.clear()
        elif now == due and revision == 0:
            self.week.update((expected, due, 1, gone))
            yield from self.told(key, expected, 1)

    def told(self, key, expected, revision: int) -> Iterator[pd.DataFrame]:
        bars = sorted((k[0], v) for k, v in self.bars.iterator())
        at = lambda k: [v[k] for _, v in bars if v[k] is not None]
        opens, highs, lows, closes, volumes = map(at, range(5))
        if opens and highs and lows and closes:
            yield pd.DataFrame([(key[0], key[1], opens[0], max(highs), min(lows), closes[-1], sum(volumes) if volumes else None, bars[-1][0], expected, revision)], columns=["symbol", "week", *VALUES, "week_end", "expected_week_end", "revision"])

    def close(self) -> None:
        pass


def weekly_bars_stream(bars: DataFrame, week_ends: DataFrame, late: str = "6 hours", keep: int = 370) -> DataFrame:
    """Revisions of weekly bars (TOLD) from a stream of bars with ingest_ts. week_ends: week, expected_week_end (a table)."""
    ends = week_ends.select("week", "expected_week_end")
    rows = bars.select("symbol", "session_date", *VALUES, "ingest_ts", week_of(F.col("session_date")).alias("week")).withWatermark("ingest_ts", late).join(ends, "week", "left")
    return rows.groupBy("symbol", "week").transformWithStateInPandas(_Weeks(keep), TOLD, "Update", "EventTime")


def latest(told: DataFrame) -> DataFrame:
    """Of each week the last revision."""
    rest = [c for c in told.columns if c not in ("symbol", "week", "revision")]
    return told.groupBy("symbol", "week").agg(F.max_by(F.struct(*rest), "revision").alias("r")).select("symbol", "week", "r.*")
