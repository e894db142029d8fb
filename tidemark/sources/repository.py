"""Bars of many symbols over a range of dates, from a cache that asks providers for what it lacks.

A refresh is an algebra of intervals of sessions, by symbol: asked, less what the cache holds, less what providers have
answered for before, gives the intervals to fetch: heads, tails and holes inside. A tail reaches back over the last bars
held, as vendors revise these. Providers are asked for all intervals of all symbols at once, as a table; what they give
is merged into the cache, the answers are noted (an interval that a provider answered isn't asked again, even where it
had no bars), and the range is read back on the price basis asked for, as known at its end.

A provider is a function from intervals (symbol, from_date, to_date) to what was fetched: a row for each bar, and for
each interval one row more without session_date, whose `error` is null if it was answered. `from_table` and `from_calls`
make such functions, `in_turn` asks the next one for what the one before didn't answer.

Intervals stay distributed: nothing of them is collected. Symbols without bars, ranges without sessions and an empty
list of symbols give empty results. Bars without a symbol or date are none, and are left to the quality checks.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prices import adjusted
from .bars import RAW_SCHEMA, DataUnavailable
from .cache import BarCache
from .shared import stored

INTERVAL = ["symbol", "from_date", "to_date"]
FETCHED = T.StructType([*(f for f in RAW_SCHEMA if f.name != "ingest_ts"), T.StructField("from_date", T.DateType()), T.StructField("to_date", T.DateType()), T.StructField("error", T.StringType())])
Provider = Callable[[DataFrame], DataFrame]


def _shaped(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FETCHED])


def from_table(table: DataFrame, name: str = "table") -> Provider:
    """Bars of a table (symbol, session_date, open, ...): joined by symbol, within each of its few intervals."""

    def fetch(intervals: DataFrame) -> DataFrame:
        rows = table.drop("source", "from_date", "to_date", "error").join(intervals, "symbol").where(F.col("session_date").between(F.col("from_date"), F.col("to_date")))
        return _shaped(rows.withColumn("source", F.lit(name))).unionByName(_shaped(intervals.withColumn("source", F.lit(name))))

    return fetch


def from_calls(call: Callable[[str, object, object], pd.DataFrame], name: str, tries: int = 3, wait: float = 1.0) -> Provider:
    """Bars that call(symbol, from_date, to_date) gives as a frame, one interval after another in each task.

    DataUnavailable is an answer's error at once; any other exception is tried again with doubled waits first."""

    def one(symbol, a, b) -> tuple[pd.DataFrame, str | None]:
        for k in range(tries):
            try:
                return call(symbol, a, b), None
            except DataUnavailable as e:
                return pd.DataFrame(), str(e)
            except Exception as e:  # a connection may come back
                if k == tries - 1:
                    return pd.DataFrame(), f"{type(e).__name__}: {e}"
                time.sleep(wait * 2**k)
        raise AssertionError

    def run(frames):
        for frame in frames:
            for symbol, a, b in frame[INTERVAL].itertuples(index=False):
                bars, error = one(symbol, a, b)
                mark = pd.DataFrame([{"error": error}], columns=FETCHED.names, dtype=object)
                rows = pd.concat([bars.reindex(columns=FETCHED.names).astype(object), mark]).assign(symbol=symbol, from_date=a, to_date=b, source=name)
                yield pd.DataFrame({f.name: rows[f.name].astype(float) if isinstance(f.dataType, T.DoubleType) else rows[f.name].where(rows[f.name].notna(), None) for f in FETCHED})

    return lambda intervals: intervals.select(*INTERVAL).repartition(*INTERVAL).mapInPandas(run, FETCHED)


def in_turn(*providers: Provider) -> Provider:
    """Each interval from the first provider that answers it; the error of the last one if none does."""

    def fetch(intervals: DataFrame) -> DataFrame:
        out, rest = None, intervals
        for k, provider in enumerate(providers):
            got = stored(provider(rest))
            if k < len(providers) - 1:
                rest = got.where("session_date IS NULL AND error IS NOT NULL").select(*INTERVAL)
                got = got.join(rest, INTERVAL, "left_anti")
            out = got if out is None else out.unionByName(got)
        return out

    return fetch


def missing_intervals(symbols: DataFrame, held: DataFrame, answered: DataFrame, calendar: DataFrame, start: str, end: str, overlap: int = 10) -> DataFrame:
    """symbol, from_date, to_date, kind (HEAD, INSIDE, TAIL or WHOLE) of what symbols lack between start and end.

    held: bars (symbol, session_date); answered: intervals; calendar: session_date, session_no. The sessions that a symbol
    has, sorted, with the furthest one reached before each: where the next begins beyond it, sessions are missing."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    no = calendar.select("session_date", "session_no")
    span = no.where(F.col("session_date").between(a, b)).agg(F.min("session_no").alias("a"), F.max("session_no").alias("b")).first()
    if span.a is None:
        return symbols.select("symbol", a.alias("from_date"), a.alias("to_date"), F.lit("").alias("kind")).limit(0)
    asked = symbols.select("symbol").distinct()
    have = held.join(no, "session_date").select("symbol", F.col("session_no").alias("lo"), F.col("session_no").alias("hi"))
    told = answered.join(no.withColumnsRenamed({"session_date": "from_date", "session_no": "lo"}), "from_date").join(no.withColumnsRenamed({"session_date": "to_date", "session_no": "hi"}), "to_date").select("symbol", "lo", "hi")
    have = have.unionByName(told).where(F.col("hi").between(span.a, span.b) | F.col("lo").between(span.a, span.b) | ((F.col("lo") < span.a) & (F.col("hi") > span.b)))
    # one mark more behind the end closes the tail
    marks = have.join(asked, "symbol", "left_semi").unionByName(asked.select("symbol", F.lit(span.b + 1).alias("lo"), F.lit(span.b + 1).alias("hi")))
    before = Window.partitionBy("symbol").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    gaps = marks.withColumn("reach", F.coalesce(F.max("hi").over(before), F.lit(span.a - 1))).where("lo > reach + 1")
    gaps = gaps.select("symbol", (F.col("reach") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))
    gaps = gaps.withColumns({"lo": F.greatest("lo", F.lit(span.a)), "hi": F.least("hi", F.lit(span.b))})
    at_end, at_start = F.col("hi") == span.b, F.col("lo") == span.a
    gaps = gaps.withColumn("kind", F.when(at_end & at_start, "WHOLE").when(at_end, "TAIL").when(at_start, "HEAD").otherwise("INSIDE"))
    # a tail begins some days before the last bar, and takes in the gaps that reach there
    last = held.where(F.col("session_date") <= b).groupBy("symbol").agg(F.max("session_date").alias("last"))
    back = gaps.where("kind = 'TAIL'").select("symbol").join(last, "symbol")
    back = back.select("symbol", F.explode(F.sequence(F.date_sub("last", int(overlap * 1.5) + 3), "last")).alias("session_date"))
    back = back.join(no, "session_date").groupBy("symbol").agg(F.greatest(F.min("session_no"), F.lit(span.a)).alias("back"))
    gaps = gaps.join(back, "symbol", "left")
    tail = F.coalesce((F.col("kind") == "TAIL") | (F.col("hi") >= F.col("back") - 1), F.lit(False))
    gaps = gaps.groupBy("symbol", tail.alias("tail"), F.when(~tail, F.col("lo")).alias("one")).agg(F.min(F.when(tail, F.least("lo", "back")).otherwise(F.col("lo"))).alias("lo"), F.max("hi").alias("hi"), F.max_by("kind", "hi").alias("kind"))
    day = lambda k, name: no.withColumnsRenamed({"session_no": k, "session_date": name})
    return gaps.join(day("lo", "from_date"), "lo").join(day("hi", "to_date"), "hi").select(*INTERVAL, "kind")


@dataclass
class Refreshed:
    """bars: the range on the price basis asked for. diagnostics: a row for each symbol. fetched: a row for each interval."""

    bars: DataFrame
    diagnostics: DataFrame
    fetched: DataFrame


class Repository:
    """A cache, a provider and a calendar (session_date, session_no); see the module."""

    def __init__(self, cache: BarCache, provider: Provider, calendar: DataFrame, basis: str = "SPLIT_ADJUSTED", overlap: int = 10):
        self.cache, self.provider, self.calendar, self.basis, self.overlap = cache, provider, calendar, basis, overlap
        self.answers = BarCache(cache.spark, f"{cache.path}/answers", keys=tuple(INTERVAL), date="from_date")

    def held(self) -> DataFrame:
        rows = self.cache.read()
        return self.cache.spark.createDataFrame([], RAW_SCHEMA) if rows is None else rows

    def answered(self) -> DataFrame:
        rows = self.answers.read()
        return self.cache.spark.createDataFrame([], T.StructType([f for f in FETCHED if f.name in INTERVAL])) if rows is None else rows.select(*INTERVAL)

    def missing(self, symbols: DataFrame, start: str, end: str) -> DataFrame:
        return missing_intervals(symbols, self.held(), self.answered(), self.calendar, start, end, self.overlap)

    def refresh(self, symbols: DataFrame, start: str, end: str) -> Refreshed:
        """Fetches what is missing, merges it, and reads the range back.

        Diagnostics, for each symbol asked for: status (HIT: nothing was asked; REFRESHED; FILLED: nothing was held before;
        STALE: a provider failed, what is held is served; UNAVAILABLE: it failed and nothing is held at the range's start),
        error, refresh_start and refresh_end, rows_before, rows_after, rows_downloaded, previous_latest_session and
        new_latest_session, resolved_source (of the latest bar fetched, else held), internal_gap_sessions (an array: sessions
        between the range's first and last bar without one) and range_complete."""
        asked = stored(symbols.select("symbol").distinct())
        before = stored(self.held().groupBy("symbol").agg(F.count(F.lit(1)).alias("rows_before"), F.min("session_date").alias("first"), F.max("session_date").alias("previous_latest_session")))
        intervals = stored(self.missing(asked, start, end))
        got = stored(self.provider(intervals.select(*INTERVAL)).withColumn("ingest_ts", F.current_timestamp()))
        self.cache.upsert(got.where("session_date IS NOT NULL").drop("from_date", "to_date", "error"))
        # only once the bars are in: a crash between the two asks again
        self.answers.upsert(got.where("session_date IS NULL AND error IS NULL").select(*INTERVAL, "ingest_ts"))
        after, a, b = self.held(), F.lit(start).cast("date"), F.lit(end).cast("date")
        bars = adjusted(after, self.basis, end).where(F.col("session_date").between(a, b)).join(asked, "symbol", "left_semi")
        of = Window.partitionBy("symbol").orderBy("session_date")
        no = self.calendar.select("session_date", "session_no")
        inside = after.where(F.col("session_date").between(a, b)).select("symbol", "session_date").distinct().join(no, "session_date")
        lost = inside.withColumn("next", F.lead("session_no").over(of)).where("next > session_no + 1").select("symbol", F.explode(F.sequence(F.col("session_no") + 1, F.col("next") - 1)).alias("session_no"))
        lost = lost.join(no, "session_no").groupBy("symbol").agg(F.sort_array(F.collect_list("session_date")).alias("internal_gap_sessions"))
        now = after.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows_after"), F.max("session_date").alias("new_latest_session"), F.max(F.struct("ingest_ts", "session_date", "source")).alias("s"), F.count_if(F.col("session_date").between(a, b)).alias("inside"))
        asks = got.groupBy("symbol").agg(F.min("from_date").alias("refresh_start"), F.max("to_date").alias("refresh_end"), F.count("session_date").alias("rows_downloaded"), F.max(F.when(F.col("session_date").isNull(), F.col("error"))).alias("error"))
        out = asked.join(before, "symbol", "left").join(asks, "symbol", "left").join(now, "symbol", "left").join(lost, "symbol", "left")
        known = F.col("first") <= F.greatest(a, F.lit(self.calendar.where(F.col("session_date") >= a).agg(F.min("session_date")).first()[0]).cast("date"))
        status = F.when(F.col("error").isNotNull(), F.when(known, "STALE").otherwise("UNAVAILABLE")).when(F.col("refresh_start").isNull(), "HIT").when(F.col("rows_before").isNull(), "FILLED").otherwise("REFRESHED")
        none = F.array().cast("array<date>")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        diagnostics = out.select("symbol", status.alias("status"), "error", "refresh_start", "refresh_end", zero("rows_before"), zero("rows_after"), zero("rows_downloaded"), "previous_latest_session", "new_latest_session", F.col("s.source").alias("resolved_source"), F.coalesce("internal_gap_sessions", none).alias("internal_gap_sessions"), ((F.coalesce("inside", F.lit(0)) > 0) & F.col("internal_gap_sessions").isNull()).alias("range_complete"))
        return Refreshed(bars, stored(diagnostics), intervals)
