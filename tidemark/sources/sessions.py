"""Special sessions: facts with sources, what is wrong with them, and when a session is open.

That a session takes place on a date and at what times are two facts. A fact about a date may leave its times open; times
that nobody verified are no fact at all, and such an entry is rejected with its reason, as are the others that validate
names: nothing is repaired or guessed. Of accepted facts about one date the one of an official document acts, else the
one verified last, else the one of the greatest version. Facts act on the calendar of regular sessions; all tables have
a row for a date, so joins are by date and the calendar's size bounds them.

Times are local to the exchange and kept as points in time (the session's time zone is UTC); a session whose times are unknown has none, and nothing may
take it for closed before its date has passed. Empty tables give empty results, or regular sessions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "session_date date, is_trading_day boolean, session_type string, session_open string, session_close string, timing_verified boolean, source string, source_url string, verified_at date, official_document_verified boolean, calendar_version string, note string"
#: The kinds of sessions, the exchange's zone and its regular hours.
TYPES = ("REGULAR", "MUHURAT", "SPECIAL", "HOLIDAY")
ZONE = "Asia/Kolkata"
OPEN, CLOSE = "09:15", "15:30"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON file, a line each; no file, no entries. A value of another type is null, which validate tells."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(path)


def _clock(c: str) -> Column:
    return F.col(c).rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$")


def validate(entries: DataFrame) -> DataFrame:
    """entries with `reasons`, an array of what is wrong with each, in a fixed order; empty if it is accepted."""
    verified, trading = F.coalesce("timing_verified", F.lit(False)), F.col("is_trading_day")
    opens, closes = F.col("session_open").isNotNull(), F.col("session_close").isNotNull()
    rules = {
        "NO_DATE": F.col("session_date").isNull(), "NO_TRADING_FLAG": trading.isNull(), "UNKNOWN_TYPE": ~F.coalesce(F.col("session_type").isin(*TYPES), F.lit(False)), "NO_SOURCE": F.coalesce(F.trim("source"), F.lit("")) == "",
        "UNVERIFIED_TIME": ~verified & (opens | closes), "TIME_MISSING": verified & ~(opens & closes), "NOT_A_CLOCK_TIME": (opens & ~_clock("session_open")) | (closes & ~_clock("session_close")),
        "CLOSES_BEFORE_OPENING": F.coalesce(_clock("session_open") & _clock("session_close") & (F.col("session_close") <= F.col("session_open")), F.lit(False)), "CLOSED_BUT_NO_HOLIDAY": F.coalesce(~trading & (F.col("session_type") != "HOLIDAY"), F.lit(False)), "HOLIDAY_BUT_TRADING": F.coalesce(trading & (F.col("session_type") == "HOLIDAY"), F.lit(False)),
    }
    return entries.withColumn("reasons", F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in rules.items()])))


def acting(entries: DataFrame) -> DataFrame:
    """One accepted entry for each date. What ranks equal is settled by the entries' other columns, so the choice is fixed."""
    good = validate(entries).where(F.size("reasons") == 0).drop("reasons")
    rest = [c for c in good.columns if c != "session_date"]
    rank = F.struct(F.coalesce("official_document_verified", F.lit(False)), "verified_at", "calendar_version", F.struct(*rest).alias("e"))
    return good.groupBy("session_date").agg(F.max(rank).alias("r")).select("session_date", "r.e.*")


def _at(date: Column, clock: Column, zone: str) -> Column:
    return F.to_utc_timestamp(F.to_timestamp(F.concat(date.cast("string"), F.lit(" "), clock), "yyyy-MM-dd HH:mm"), zone)


def session_table(regular: DataFrame, entries: DataFrame | None = None, hours: tuple[str, str] = (OPEN, CLOSE), zone: str = ZONE) -> DataFrame:
    """session_date, is_trading_day, session_open, session_close (in UTC, null if unknown), is_special, session_type, note.

    regular: session_date of sessions with regular hours. entries: facts, accepted or not; those about dates that have no
    regular session add one, or a holiday's row that says so."""
    days = regular.select("session_date").where("session_date IS NOT NULL").distinct()
    if entries is None:
        entries = regular.sparkSession.createDataFrame([], ENTRY)
    e = acting(entries)
    told = e.select("session_date", F.struct("is_trading_day", "session_type", "session_open", "session_close", "source", "source_url", "timing_verified").alias("e"))
    rows = days.withColumn("regular", F.lit(True)).join(told, "session_date", "full")
    special = F.col("e").isNotNull()
    trading = F.when(special, F.col("e.is_trading_day")).otherwise(True)
    clock = lambda name, usual: F.when(trading, F.when(special, F.col(f"e.{name}")).otherwise(usual))
    note = F.when(special, F.concat(F.col("e.session_type"), F.lit("; timing_verified="), F.coalesce("e.timing_verified", F.lit(False)).cast("string"), F.lit("; source="), F.coalesce("e.source_url", "e.source")))
    day = F.col("session_date")
    return rows.select("session_date", trading.alias("is_trading_day"), _at(day, clock("session_open", hours[0]), zone).alias("session_open"), _at(day, clock("session_close", hours[1]), zone).alias("session_close"), (special & trading).alias("is_special"), F.when(special, F.col("e.session_type")).otherwise("REGULAR").alias("session_type"), note.alias("note"))


def session_info(dates: DataFrame, sessions: DataFrame) -> DataFrame:
    """What session_table knows of each distinct date asked for (date), with has_verified_timing; unknown dates have no session."""
    known = dates.select(F.col("date").alias("session_date")).distinct().join(sessions, "session_date", "left")
    trading = F.coalesce("is_trading_day", F.lit(False))
    return known.withColumns({"is_trading_day": trading, "is_special": F.coalesce("is_special", F.lit(False)), "has_verified_timing": trading & F.col("session_open").isNotNull() & F.col("session_close").isNotNull()})


def analysis_dates(asks: DataFrame, sessions: DataFrame, cutoff: str = "16:00", back: int = 30, zone: str = ZONE) -> DataFrame:
    """asks (now, a UTC timestamp, and manual, a date or null) with analysis_date, mode and error, for any number of asks.

    AUTOMATIC: the latest session of the last `back` days that has ended: its date has passed, or it is today's, has a known
    close, and now is at or past both that and the cutoff. MANUAL: the date asked for, never moved; error says why it can't
    be: FUTURE, NO_SESSION, UNVERIFIED_TIMING (today's, of unknown times) or NOT_ENDED. NONE: no session has ended, or now
    is null. What is known of each day, the latest session before it included, is found from the sessions alone: a row for
    a day, hence the broadcast. Asks meet it once, where they are, and are never shuffled."""
    names = asks.columns
    shut = F.date_format(F.from_utc_timestamp("session_close", zone), "HH:mm:ss")
    trading = sessions.where("is_trading_day").select("session_date", shut.alias("_shut"), F.explode(F.sequence(F.lit(0), F.lit(back))).alias("_later"))
    own = F.col("_later") == 0
    days = trading.groupBy(F.date_add("session_date", F.col("_later")).alias("_day")).agg(F.max(own).alias("_session"), F.min(F.when(own, F.col("_shut"))).alias("_shut"), F.max(F.when(~own, F.col("session_date"))).alias("_past"))
    local, manual = F.from_utc_timestamp("now", zone), F.col("manual")
    rows = asks.withColumns({"_today": local.cast("date"), "_clock": F.date_format(local, "HH:mm:ss")}).withColumn("_day", F.coalesce("manual", "_today")).join(F.broadcast(days), "_day", "left")
    day, today, shut = F.col("_day"), F.col("_today"), F.col("_shut")
    session = F.coalesce("_session", F.lit(False))
    ended = session & ((day < today) | ((day == today) & shut.isNotNull() & (F.col("_clock") >= F.greatest(shut, F.lit(f"{cutoff}:00")))))
    found = F.when(ended, day).when(manual.isNull(), F.col("_past"))
    error = F.when(manual > today, "FUTURE").when(manual.isNotNull() & ~session, "NO_SESSION").when(found.isNotNull(), F.lit(None).cast("string")).when(manual.isNull(), "NONE").when(shut.isNull(), "UNVERIFIED_TIMING").otherwise("NOT_ENDED")
    return rows.select(*names, F.when(error.isNull(), found).alias("analysis_date"), F.when(manual.isNull(), "AUTOMATIC").otherwise("MANUAL").alias("mode"), error.alias("error"))
