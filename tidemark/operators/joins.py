"""Weekly bars, as-of joins and the execution bar lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_date
from ..sources.calendar import filled, week_of


def weekly_bars(daily: DataFrame, week_ends: DataFrame | None = None, keys=("symbol",)) -> DataFrame:
    """Bars by ISO week, named by the last session seen, with the last scheduled one as availability.

    first and last skip nulls; a week without one of open, high, low, close is dropped. Combines on the map side."""
    some = lambda pick, c: pick(F.col(c), F.when(F.col(c).isNotNull(), F.col("session_date")))
    out = daily.groupBy(*keys, week_of(F.col("session_date")).alias("week")).agg(
        some(F.min_by, "open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), some(F.max_by, "close").alias("close"),
        F.sum("volume").alias("volume"), F.max("session_date").alias("week_end"),
    )
    if week_ends is None:
        out = out.withColumn("expected_week_end", F.col("week_end"))
    else:
        out = out.join(week_ends.withColumnRenamed("expected_week_end", "_due"), "week", "left").withColumn("expected_week_end", F.greatest("week_end", "_due")).drop("_due")
    return out.dropna(subset=["open", "high", "low", "close"])


def asof(left: DataFrame, right: DataFrame, right_date: str, payload: list[str], keys=("symbol",)) -> DataFrame:
    """left with the payload of the last right row of its keys dated at or before its session_date.

    A union ordered by date, right rows first, and the last struct: one shuffle by keys, no range join. The row decides,
    nulls within it included."""
    names = left.columns
    a = left.select(*keys, F.col("session_date").alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_l"), F.lit(None).cast(right.select(F.struct(*payload).alias("x")).schema["x"].dataType).alias("_r"))
    b = right.select(*keys, F.col(right_date).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*payload).alias("_r"))
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    return out.select("_l.*", *[F.col(f"_r.{p}").alias(p) for p in payload])


def asof_series(left: DataFrame, right: DataFrame, payload: list[str], calendar: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """As-of for a right side with one row for each date at most (an index): filled over the calendar, then joined by date.

    The filled table has a row for each day, so Spark may broadcast it by its own size check. dates: the dates of left
    from a plan that is cheaper to read than left itself."""
    days = calendar.select("session_date").unionByName((left if dates is None else dates).select("session_date")).unionByName(right.select("session_date")).distinct()
    known = filled(days.join(right.select("session_date", F.struct(*payload).alias("_r")), "session_date", "left"), "_r")
    return left.join(known.select("session_date", *[F.col(f"_r.{p}").alias(p) for p in payload]), "session_date", "left")


def weekly_as_of(weekly: DataFrame, as_of: str, keys=("symbol",)) -> DataFrame:
    """Each symbol's last weekly bar known at a date."""
    rest = [c for c in weekly.columns if c not in keys]
    known = weekly.where(F.col("expected_week_end") <= F.lit(as_of).cast("date"))
    return known.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("expected_week_end")).alias("r")).select(*keys, "r.*")


def symbol_as_of(dates: DataFrame, history: DataFrame) -> DataFrame:
    """Distinct dates (security_id, date) with the symbol whose interval (valid_from, valid_to, both inclusive) holds the date.

    Of several intervals the one that starts first; null if none. An equi-join on the security first, so the range is
    tried within one security's few intervals."""
    d, h = dates.select("security_id", "date").distinct().alias("d"), history.alias("h")
    hit = F.expr("d.security_id = h.security_id AND d.date >= h.valid_from AND d.date <= coalesce(h.valid_to, DATE '9999-12-31')")
    return d.join(h, hit, "left").groupBy("d.security_id", "d.date").agg(F.min_by("h.symbol", "h.valid_from").alias("symbol"))


def missing_sessions(bars: DataFrame, calendar: DataFrame, keys=("symbol",)) -> DataFrame:
    """Sessions between a symbol's first and last bar that it has no bar for.

    Each bar asks for the sessions up to its next bar by their numbers, so no symbol meets the whole calendar."""
    no = calendar.select("session_date", "session_no")
    rows = bars.select(*keys, "session_date").distinct().join(no, "session_date")
    gaps = rows.withColumn("_next", F.lead("session_no").over(by_date(*keys))).where("_next > session_no + 1")
    lost = gaps.select(*keys, F.explode(F.sequence(F.col("session_no") + 1, F.col("_next") - 1)).alias("session_no"))
    return lost.join(no, "session_no").select(*keys, "session_date")


def with_execution(bars: DataFrame, calendar: DataFrame, model: str = "next_open", keys=("symbol",)) -> DataFrame:
    """bars with execution_date, execution_price and execution_status of a signal on each row.

    The execution session comes from the calendar; if the symbol has no bar there, the status is DATA_GAP: no later bar
    takes its place."""
    if model == "same_close":
        return bars.withColumns({"execution_date": F.col("session_date"), "execution_price": F.col("close"), "execution_status": F.when(F.col("close").isNotNull(), "OK").otherwise("DATA_GAP")})
    price = {"next_open": "open", "next_close": "close"}.get(model)
    if price is None:
        raise ValueError(f"unknown execution model {model!r}")
    w = by_date(*keys)
    # the execution bar can only be the symbol's own next row
    due = bars.join(calendar.select("session_date", F.col("next_session").alias("_due")), "session_date", "left")
    due = due.withColumns({"_next": F.lead("session_date").over(w), "_price": F.lead(price).over(w)})
    met = F.col("_next") == F.col("_due")
    return due.withColumns({"execution_date": F.col("_due"), "execution_price": F.when(met, F.col("_price")), "execution_status": F.when(met & F.col("_price").isNotNull(), "OK").otherwise("DATA_GAP")}).drop("_due", "_next", "_price")


def cross_check(a: DataFrame, b: DataFrame, tolerance_pct: float = 0.5, names=("a", "b")) -> DataFrame:
    """Prices of two sources by symbol, date and field, with their difference in percent of the first."""
    long = lambda df, v: df.unpivot(["symbol", "session_date"], ["open", "high", "low", "close"], "field", v)
    both = long(a.select("symbol", "session_date", "open", "high", "low", "close"), "value_a").join(long(b.select("symbol", "session_date", "open", "high", "low", "close"), "value_b"), ["symbol", "session_date", "field"])
    diff = F.try_divide(F.abs(F.col("value_a") - F.col("value_b")), F.col("value_a")) * 100
    return both.withColumns({"source_a": F.lit(names[0]), "source_b": F.lit(names[1]), "diff_pct": diff, "status": F.when(diff < tolerance_pct, "MATCH").otherwise("DIFFERS")})
