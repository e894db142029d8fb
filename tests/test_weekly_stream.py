"""Streamed weekly bars against the batch ones, with shuffled, repeated, late and corrected input."""

import datetime as dt
import random

import pandas as pd
import pytest

from tidemark.operators import joins
from tidemark.sources.cache import merged
from tidemark.sources.calendar import expected_week_ends
from tidemark.streaming import weekly

D = dt.date
SCHEMA = "symbol string, session_date date, open double, high double, low double, close double, volume double, ingest_ts timestamp"
DAYS = [d.date() for d in pd.bdate_range("2024-01-01", "2024-02-16")]
SUNDAY = D(2024, 1, 21)  # a special session that follows a Friday


@pytest.fixture(scope="module")
def ends(spark):
    return expected_week_ends(spark.createDataFrame([(d,) for d in [*DAYS, SUNDAY]], "session_date date"))


def bar(symbol, day, close, at=None, **k):
    prices = dict.fromkeys(("open", "high", "low", "close")) if close is None else {"open": close - 1.0, "high": close + 2.0, "low": close - 2.0, "close": float(close)}
    row = {"symbol": symbol, "session_date": day, **prices, "volume": 10.0, "ingest_ts": at or dt.datetime.combine(day, dt.time(20))} | k
    return tuple(row.values())


def streamed(spark, tmp_path, name, batches, ends, **k):
    """All revisions that a stream of these batches tells, batch by batch."""
    source, out = f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-out"
    spark.conf.set(*weekly.PROVIDER)
    try:
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            told = weekly.weekly_bars_stream(spark.readStream.schema(SCHEMA).parquet(source), ends, **k)
            write = lambda df, n: df.write.mode("append").parquet(out)
            told.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/{name}-cp").trigger(availableNow=True).start().awaitTermination()
            yield spark.read.schema(weekly.TOLD).parquet(out)
    finally:
        spark.conf.unset(weekly.PROVIDER[0])


def test_the_calendar_ends_a_week(spark, tmp_path, ends):
    friday, monday = D(2024, 1, 19), D(2024, 1, 22)
    batches = [[bar("A", D(2024, 1, 15), 10), bar("A", friday, 14)], [bar("A", friday, 14, dt.datetime(2024, 1, 20, 3)), bar("B", friday, 5, dt.datetime(2024, 1, 20, 4))], [bar("A", SUNDAY, 20)], [bar("A", monday, 30)], [bar("A", D(2024, 1, 16), 50, dt.datetime(2024, 1, 23, 1)), bar("A", D(2024, 1, 15), 1, dt.datetime(2024, 1, 1))]]
    seen = [{(r.symbol, r.week, r.revision): r for r in told.collect()} for told in streamed(spark, tmp_path, "one", batches, ends)]
    week = D(2024, 1, 15)
    assert seen[0] == seen[1] == seen[2] == {}  # neither Friday nor Saturday nor Sunday itself ends it
    a = seen[3]["A", week, 1]
    assert (a.open, a.high, a.low, a.close, a.volume, a.week_end, a.expected_week_end) == (9, 22, 8, 20, 30, SUNDAY, SUNDAY) and seen[3]["B", week, 1].week_end == friday
    assert seen[4]["A", week, 2].high == 52 and len(seen[4]) == 3  # a correction reopens it; an older bar doesn't


def test_streamed_equals_batch(spark, tmp_path, ends):
    rng = random.Random(4)
    rows = [bar(s, d, 100 + rng.randrange(50)) for s in "ABC" for d in [*DAYS, SUNDAY] if rng.random() < 0.9]
    rows += [bar("A", d, None, open=None, high=None, low=None) for d in DAYS[5:7]] + [bar("D", d, None, open=1.0, high=None, low=None) for d in DAYS[:5]]
    fixed = [(*r[:2], *[x if x is None else x + 7 for x in r[2:6]], *r[6:]) for r in rng.sample(rows, 30)]
    late = [rows.pop(rng.randrange(len(rows))) for _ in range(40)]  # of any session
    rng.shuffle(rows)
    # stamped as they arrive: bars in any order, repeats, corrections and late bars, then one that moves the clock on
    arrivals = [rows[::2] + rows[::10], rows[1::2] + rng.sample(rows, 20), fixed[:15] + late[:20], late[20:] + fixed[15:]]
    stamped = [[(*r[:7], dt.datetime(2024, 1, 18) + dt.timedelta(days=9 * k)) for r in batch] for k, batch in enumerate(arrivals)]
    batches = [*stamped, [bar("Z", D(2024, 3, 29), 1, dt.datetime(2024, 4, 2))]]
    *_, told = streamed(spark, tmp_path, "two", batches, ends)
    every = spark.createDataFrame([r for batch in stamped for r in batch], SCHEMA)
    daily = merged(every.limit(0), every).drop("ingest_ts")
    want = joins.weekly_bars(daily, ends).select("symbol", "week", *weekly.VALUES, "week_end", "expected_week_end")
    got = weekly.latest(told).where("symbol <> 'Z'").select(want.columns)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and want.count() >= 20
