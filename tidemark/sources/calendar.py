"""The trading calendar as a table of sessions, and what is asked of it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_of(date: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", date).cast("date")


def week_label(date: Column) -> Column:
    """YYYY-Www of the ISO week."""
    return F.concat(F.lpad(F.extract(F.lit("yearofweek"), date).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def with_overrides(base: DataFrame, overrides: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sessions of base (session_date) without the holidays and with the special sessions of overrides (session_date,
    session_type); overrides act inside start..end alone."""
    inside = F.lit(True)
    if start:
        inside = inside & (F.col("session_date") >= F.lit(start).cast("date"))
    if end:
        inside = inside & (F.col("session_date") <= F.lit(end).cast("date"))
    acting = overrides.where(inside)
    off = acting.where("session_type = 'HOLIDAY'").select("session_date")
    on = acting.where("session_type <> 'HOLIDAY'").select("session_date")
    return base.select("session_date").where(inside).join(off, "session_date", "left_anti").unionByName(on).distinct()


def _year(date: str) -> Column:
    return F.coalesce(F.year(date), F.lit(0)).alias("_year")


def across_years(rows: DataFrame, *summaries: Column, carry: dict[str, Column]) -> DataFrame:
    """_year and what is carried into each year of rows: rows are summed up by year, `carry` are windows over these.

    A table with a row for each year is all that one task orders; within years, years are tasks of their own."""
    return rows.groupBy("_year").agg(*summaries).select("_year", *[c.alias(k) for k, c in carry.items()])


#: Years before and after, for `carry`.
def _earlier() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)


def _later() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy("_year").rowsBetween(1, Window.unboundedFollowing)


def calendar_table(sessions: DataFrame) -> DataFrame:
    """session_date with session_no, next_session, prev_session, week and expected_week_end. Numbers and neighbours are found within years, and carried from year to year."""
    days = sessions.select("session_date").where("session_date IS NOT NULL").distinct().withColumn("_year", _year("session_date"))
    week = Window.partitionBy("week")
    inside = Window.partitionBy("_year").orderBy("session_date")
    day = F.col("session_date")
    years = across_years(days, F.count(F.lit(1)).alias("n"), F.min(day).alias("a"), F.max(day).alias("b"), carry={"_before": F.coalesce(F.sum("n").over(_earlier()), F.lit(0)), "_last": F.max("b").over(_earlier()), "_first": F.min("a").over(_later())})
    out = days.withColumns({"_no": F.row_number().over(inside), "_next": F.lead(day).over(inside), "_prev": F.lag(day).over(inside)}).join(years, "_year")
    out = out.select("session_date", week_of(day).alias("week"), (F.col("_before") + F.col("_no")).cast("int").alias("session_no"), F.coalesce("_next", "_first").alias("next_session"), F.coalesce("_prev", "_last").alias("prev_session"))
    return out.select("session_date", "week", F.max("session_date").over(week).alias("expected_week_end"), "session_no", "next_session", "prev_session")


def expected_week_ends(sessions: DataFrame) -> DataFrame:
    """week and the last scheduled session in it."""
    return sessions.groupBy(week_of(F.col("session_date")).alias("week")).agg(F.max("session_date").alias("expected_week_end"))


def neighbours(dates: DataFrame, sessions: DataFrame, within: int = 30) -> DataFrame:
    """For each distinct date asked for (date): the sessions strictly before and after, null beyond `within` days. A null date has none.

    Found within the date's year, else carried from the years around it."""
    s = sessions.select(F.col("session_date").alias("at"), F.col("session_date").alias("s")).where("s IS NOT NULL").distinct()
    marks = s.unionByName(dates.select(F.col("date").alias("at"), F.lit(None).cast("date").alias("s")).distinct()).withColumns({"_year": _year("at"), "_day": F.unix_date("at")})
    inside = Window.partitionBy("_year").orderBy("_day")
    before, after = inside.rangeBetween(Window.unboundedPreceding, -1), inside.rangeBetween(1, Window.unboundedFollowing)
    years = across_years(marks, F.min("s").alias("a"), F.max("s").alias("b"), carry={"_last": F.max("b").over(_earlier()), "_first": F.min("a").over(_later())})
    seen = marks.select("at", "s", "_year", F.max("s").over(before).alias("p"), F.min("s").over(after).alias("n")).where("s IS NULL").join(years, "_year")
    near = lambda c: F.when(F.abs(F.datediff(c, F.col("at"))) <= within, c)
    return seen.select(F.col("at").alias("date"), near(F.coalesce("p", "_last")).alias("prev_session"), near(F.coalesce("n", "_first")).alias("next_session"))


def filled(days: DataFrame, value: str) -> DataFrame:
    """days (session_date, distinct) with `value` as of each day: its own or the last one before that isn't null."""
    rows = days.withColumn("_year", _year("session_date"))
    inside = Window.partitionBy("_year").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    years = across_years(rows, F.max_by(value, F.when(F.col(value).isNotNull(), F.col("session_date"))).alias("v"), carry={"_carried": F.last("v", ignorenulls=True).over(_earlier())})
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(inside)).join(years, "_year").withColumn(value, F.coalesce(value, "_carried")).drop("_year", "_carried")


def sessions_between(pairs: DataFrame, calendar: DataFrame) -> DataFrame:
    """pairs (start, end) with the number of sessions strictly between, both being sessions."""
    no = calendar.select("session_date", "session_no")
    a = no.withColumnsRenamed({"session_date": "start", "session_no": "a"})
    b = no.withColumnsRenamed({"session_date": "end", "session_no": "b"})
    return pairs.join(a, "start").join(b, "end").withColumn("between", F.greatest(F.lit(0), F.col("b") - F.col("a") - 1)).drop("a", "b")


def holiday_differences(weekdays_off: DataFrame, reference: DataFrame) -> DataFrame:
    """Holidays (holiday) that only one of two lists has, weekends left out."""
    on_weekday = lambda df: df.select("holiday").where(F.weekday("holiday") < 5).distinct()
    a, b = on_weekday(weekdays_off), on_weekday(reference)
    return a.exceptAll(b).withColumn("only_in", F.lit("calendar")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("reference")))


@dataclass(frozen=True)
class AnalysisDate:
    date: dt.date
    mode: str
    reason: str


class DateError(ValueError):
    pass


def resolve_analysis_date(sessions: DataFrame, now: dt.datetime, manual: dt.date | None = None, cutoff: dt.time = dt.time(16), back: int = 30) -> AnalysisDate:
    """The session a scan is for. sessions: session_date, close_time (string HH:MM, null if unknown).

    AUTOMATIC: the latest session of the last `back` days that has closed, with now at or past the cutoff; one of unknown
    times counts only when its date has passed. MANUAL: never moved; a future date, a date without session and today
    before the cutoff or with unknown times are errors."""
    first = now.date() - dt.timedelta(days=back)
    rows = {r.session_date: r.close_time for r in sessions.where(F.col("session_date").between(F.lit(min(first, manual or first)), F.lit(max(now.date(), manual or first)))).select("session_date", "close_time").collect()}

    def done(d: dt.date) -> bool:
        if d < now.date():
            return True
        return d == now.date() and rows[d] is not None and now.time() >= max(cutoff, dt.time.fromisoformat(rows[d]))

    if manual is not None:
        if manual > now.date():
            raise DateError(f"{manual} is in the future")
        if manual not in rows:
            raise DateError(f"{manual} is no session")
        if not done(manual):
            raise DateError(f"{manual}: its times are unknown" if rows[manual] is None else f"{manual}: it is before the cutoff")
        return AnalysisDate(manual, "MANUAL", "as asked")
    found = [d for d in rows if d >= first and done(d)]
    if not found:
        raise DateError(f"no session ended in the {back} days before {now}")
    return AnalysisDate(max(found), "AUTOMATIC", "latest session that has ended")


def required_warmup(long: int = 200, lookback: int = 252, swing: int = 10, atr: int = 14, longest_rs: int = 120, memory: int = 60) -> int:
    """Sessions before the first that is used. Weekly averages of the long period need five sessions a week, three times over."""
    return max(3 * long, 5 * 3 * long, lookback + 60, 4 * swing, 5 * atr, 2 * longest_rs, memory) + 50


def warmup_start(calendar: DataFrame, start: dt.date, sessions: int) -> dt.date:
    """The session so many before start; the first one if the calendar is shorter."""
    at = calendar.where(F.col("session_date") <= F.lit(start)).agg(F.max("session_no")).first()[0] or 1
    return calendar.where(F.col("session_no") == max(1, at - sessions)).first().session_date


def folds(first: dt.date, last: dt.date, train_years: float = 3, test_years: float = 1, step_years: float | None = None) -> list[tuple[int, dt.date, dt.date, dt.date, dt.date]]:
    """(fold, train_start, train_end, test_start, test_end) by calendar years; ends are clamped and exclusive."""

    def plus(d: dt.date, years: float) -> dt.date:
        months = round(years * 12)
        y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
        for day in (d.day, 30, 29, 28):
            try:
                return dt.date(y, m + 1, day)
            except ValueError:
                pass
        raise AssertionError

    out, start = [], first
    while True:
        train_end = plus(start, train_years)
        if train_end >= last:
            return out
        out.append((len(out) + 1, start, train_end, train_end, min(plus(train_end, test_years), last)))
        start = plus(start, step_years or test_years)
