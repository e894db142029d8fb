"""A query for each operator over the driver's tables, and its SQL."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config
from .functions import costs, stats
from .oracle import cells_sql, events_sql, picked, recursive_ema, sql, stats_sql, steps
from .operators import checks, indicators as ind, joins, kernels, prices
from .plans import backtest as bt
from .plans import events as evs
from .plans import features as fts
from .plans import research, scan
from .sources import bars as src
from .sources import calendar as cal
from .sources import repository as rep
from .sources import sessions as ses
from .sources.shared import shared_dir, stored

CFG = Config()
ANALYSIS = "2001-06-15"
#: Added before rounding, here and in SQL, so that engines agree on values halfway between two results.
EPSILON = 1e-9
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None, *more: str, name: str | None = None):
    """Registers a query under its function's name, its doubles rounded to six places as in its SQL."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: rounded(f(Market(spark, sf_dir)))
        if oracle:
            text = sql(oracle, *more) if not oracle.startswith("PLAIN ") else oracle.removeprefix("PLAIN ")
            SQL[key] = text.replace(", 6)", f" + {EPSILON}, 6)")
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + EPSILON, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


class Market:
    """Bars, index and calendar of a folder of tables; each property is a plan of its own, so a query runs what it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @property
    def trades(self) -> DataFrame:
        return src.trades(self.spark, self.dir)

    @property
    def bars(self) -> DataFrame:
        return src.bars_from_trades(self.trades)

    @property
    def index(self) -> DataFrame:
        return src.bars_from_trades(self.trades, ())

    @property
    def calendar(self) -> DataFrame:
        return cal.calendar_table(self.spark.read.parquet(f"{self.dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("session_date")))

    @cached_property
    def kept(self) -> DataFrame:
        """The bars, stored: for plans that read them more than once."""
        return stored(self.bars)

    @cached_property
    def kept_index(self) -> DataFrame:
        return stored(self.index)

    @cached_property
    def sessions(self) -> DataFrame:
        """The calendar, stored."""
        return stored(self.calendar)

    @property
    def features(self) -> DataFrame:
        return fts.features(self.kept, self.kept_index, self.sessions, CFG)

    @property
    def emas(self) -> DataFrame:
        return kernels.with_recursions(self.kept, CFG.ema.periods, "sma", ("ATR14", 14))

    @property
    def raw(self) -> DataFrame:
        """Raw bars with made-up splits: 2 for 1 on each symbol's 700th row, 5 for 1 on its 1400th."""
        no = F.row_number().over(Window.partitionBy("symbol").orderBy("session_date"))
        split = F.when(no == 700, 2.0).when(no == 1400, 5.0).otherwise(0.0)
        return self.bars.withColumns({"stock_splits": split, "adj_close": F.col("close")})


R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
EMAS = ind.EMAS
KEY = ["symbol", "session_date"]


@query(f"SELECT symbol, session_date, {R('open', 'high', 'low', 'close', 'volume')} FROM bars")
def daily_bars(m):
    return m.bars


@query(f"SELECT session_date, {R('open', 'high', 'low', 'close', 'volume')} FROM index_bars")
def index_bars(m):
    return m.index


@query("SELECT session_date, session_no, next_session, prev_session, week, expected_week_end FROM cal")
def calendar_sessions(m):
    return m.calendar.select("session_date", "session_no", "next_session", "prev_session", "week", "expected_week_end")


@query("SELECT week, max(session_date) AS expected_week_end, printf('%04d-W%02d', isoyear(week), weekofyear(week)) AS label FROM cal GROUP BY week")
def expected_week_ends(m):
    return cal.expected_week_ends(m.calendar).withColumn("label", cal.week_label(F.col("week")))


@query("""SELECT d.date, (SELECT max(session_date) FROM cal WHERE session_date < d.date AND session_date >= d.date - 30) AS prev_session, (SELECT min(session_date) FROM cal WHERE session_date > d.date AND session_date <= d.date + 30) AS next_session
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) AS d""")
def session_neighbours(m):
    """Of every date on which something was ordered."""
    dates = m.spark.read.parquet(f"{m.dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date"))
    return cal.neighbours(dates, m.calendar).select("date", "prev_session", "next_session")


@query("SELECT a.session_date AS start, b.session_date AS \"end\", b.session_no - a.session_no - 1 AS between FROM cal AS a JOIN cal AS b ON b.session_no = a.session_no + 1 + a.session_no % 40")
def sessions_between(m):
    no = m.calendar.select("session_date", "session_no")
    pairs = no.select(F.col("session_date").alias("start"), (F.col("session_no") + 1 + F.col("session_no") % 40).alias("session_no")).join(no.withColumnRenamed("session_date", "end"), "session_no").select("start", "end")
    return cal.sessions_between(pairs, m.calendar)


OVERRIDES = "(DATE '1998-03-02', 'HOLIDAY'), (DATE '1998-03-07', 'SPECIAL'), (DATE '1998-03-10', 'HOLIDAY'), (DATE '1998-12-25', 'HOLIDAY'), (DATE '1992-01-01', 'SPECIAL')"


@query("SELECT session_date FROM cal WHERE session_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' AND session_date NOT IN (DATE '1998-03-02', DATE '1998-03-10') UNION SELECT DATE '1998-03-07'")
def valid_sessions(m):
    over = m.spark.sql(f"SELECT * FROM VALUES {OVERRIDES} AS t(session_date, session_type)")
    return cal.with_overrides(m.calendar, over, "1998-01-01", "1998-06-30")


@query("""SELECT day AS holiday, CASE WHEN s.session_date IS NULL THEN 'calendar' ELSE 'reference' END AS only_in FROM (SELECT CAST(x AS DATE) AS day FROM (SELECT min(session_date) AS a, max(session_date) AS b FROM cal), LATERAL (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS x)) LEFT JOIN cal AS s ON s.session_date = day LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS o FROM orders) ON o = day
WHERE isodow(day) < 6 AND (s.session_date IS NULL) <> (o IS NULL)""")
def holiday_differences(m):
    """Weekdays without a session, as the calendar has them, against weekdays without an order."""
    sessions, ordered = m.sessions.select("session_date"), m.spark.read.parquet(f"{m.dir}/orders.parquet").select(F.to_date("o_orderdate").alias("session_date"))
    days = sessions.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("session_date"))
    off = lambda df: days.join(df.distinct(), "session_date", "left_anti").select(F.col("session_date").alias("holiday"))
    return cal.holiday_differences(off(sessions), off(ordered))


@query("SELECT max(session_date) AS analysis_date, 'AUTOMATIC' AS mode FROM cal WHERE session_date <= DATE '2001-06-14'")
def analysis_date(m):
    table = ses.session_table(m.calendar).where("is_trading_day")
    sessions = table.select("session_date", F.date_format(F.from_utc_timestamp("session_close", ses.ZONE), "HH:mm").alias("close_time"))
    found = cal.resolve_analysis_date(sessions, dt.datetime(2001, 6, 15, 15, 45))
    return m.spark.createDataFrame([(found.date, found.mode)], "analysis_date date, mode string")


#: A made-up fact for each supplier, some of them wrong: its date, kind and times follow from the supplier's numbers.
FACTS = """SELECT {date} AS session_date, s_nationkey % 3 <> 0 AS is_trading_day, CASE WHEN s_nationkey % 3 = 0 THEN CASE WHEN s_nationkey = 12 THEN 'SPECIAL' ELSE 'HOLIDAY' END WHEN s_nationkey = 13 THEN 'PARTY' ELSE 'SPECIAL' END AS session_type,
CASE WHEN s_nationkey IN (2, 5, 8, 11) THEN '18:15' WHEN s_nationkey = 14 THEN '19:30' END AS session_open, CASE WHEN s_nationkey IN (2, 5, 11, 14) THEN '19:15' END AS session_close, s_nationkey IN (2, 5, 8, 14) AS timing_verified,
s_name AS source, {date} AS verified_at, s_acctbal > 5000 AS official_document_verified, s_name AS calendar_version FROM supplier"""
_SPARK_DATE, _DUCK_DATE = "date_add(DATE '1995-01-01', CAST(s_suppkey * 37 % 2500 AS INT))", "DATE '1995-01-01' + CAST(s_suppkey * 37 % 2500 AS INT)"
REASONS = "list_filter([CASE WHEN session_type = 'PARTY' THEN 'UNKNOWN_TYPE' END, CASE WHEN NOT timing_verified AND (session_open IS NOT NULL OR session_close IS NOT NULL) THEN 'UNVERIFIED_TIME' END, CASE WHEN timing_verified AND (session_open IS NULL OR session_close IS NULL) THEN 'TIME_MISSING' END, CASE WHEN session_close <= session_open THEN 'CLOSES_BEFORE_OPENING' END, CASE WHEN NOT is_trading_day AND session_type <> 'HOLIDAY' THEN 'CLOSED_BUT_NO_HOLIDAY' END], lambda x: x IS NOT NULL)"
SESSIONS = [f"facts AS MATERIALIZED (SELECT *, {REASONS} AS reasons FROM ({FACTS.format(date=_DUCK_DATE)}))", "acts AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY official_document_verified DESC, verified_at DESC, calendar_version DESC) AS k FROM facts WHERE len(reasons) = 0) WHERE k = 1)",
    "tab AS MATERIALIZED (SELECT coalesce(c.session_date, a.session_date) AS day, coalesce(a.is_trading_day, true) AS trading, CASE WHEN a.session_date IS NULL THEN '09:15' WHEN a.is_trading_day THEN session_open END AS o, CASE WHEN a.session_date IS NULL THEN '15:30' WHEN a.is_trading_day THEN session_close END AS c, a.session_date IS NOT NULL AND a.is_trading_day AS special FROM (SELECT session_date FROM cal) AS c FULL JOIN acts AS a ON a.session_date = c.session_date)"]


def _facts(m):
    m.spark.read.parquet(f"{m.dir}/supplier.parquet").createOrReplaceTempView("tidemark_supplier")
    rows = m.spark.sql(FACTS.format(date=_SPARK_DATE).replace("FROM supplier", "FROM tidemark_supplier"))
    return rows.withColumns({"source_url": F.lit(None).cast("string"), "note": F.lit(None).cast("string")})


@query("SELECT source, session_date, session_type, array_to_string(reasons, ',') AS reasons FROM facts", *SESSIONS)
def special_sessions(m):
    return ses.validate(_facts(m)).select("source", "session_date", "session_type", F.concat_ws(",", "reasons").alias("reasons"))


@query("SELECT d.session_date, coalesce(trading, false) AS is_trading_day, day || ' ' || o AS session_open, day || ' ' || c AS session_close, coalesce(special, false) AS is_special, coalesce(trading, false) AND o IS NOT NULL AND c IS NOT NULL AS has_verified_timing FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session_date FROM orders UNION SELECT session_date FROM facts) AS d LEFT JOIN tab ON day = session_date", *SESSIONS)
def session_info(m):
    """Of every order's date and every fact's."""
    facts = _facts(m)
    dates = m.spark.read.parquet(f"{m.dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date")).unionByName(facts.select(F.col("session_date").alias("date")))
    told = ses.session_info(dates, ses.session_table(m.calendar, facts))
    local = lambda c: F.date_format(F.from_utc_timestamp(c, ses.ZONE), "yyyy-MM-dd HH:mm").alias(c)
    return told.select("session_date", "is_trading_day", local("session_open"), local("session_close"), "is_special", "has_verified_timing")


ASKS = "SELECT o_orderkey AS ask, {date} AS today, o_orderkey * 37 % 1440 AS minute, CASE o_orderpriority WHEN '1-URGENT' THEN {date} WHEN '2-HIGH' THEN {later} WHEN '3-MEDIUM' THEN {earlier} END AS manual FROM orders"


@query("""SELECT ask, CASE WHEN error IS NULL THEN day END AS analysis_date, mode, error FROM (SELECT *, CASE WHEN manual > today THEN 'FUTURE' WHEN manual IS NOT NULL AND NOT coalesce(on_day, false) THEN 'NO_SESSION' WHEN day IS NOT NULL THEN NULL WHEN manual IS NULL THEN 'NONE' WHEN close IS NULL THEN 'UNVERIFIED_TIMING' ELSE 'NOT_ENDED' END AS error, CASE WHEN manual IS NULL THEN 'AUTOMATIC' ELSE 'MANUAL' END AS mode
FROM (SELECT a.*, t.trading AS on_day, t.c AS close, CASE WHEN manual IS NULL THEN CASE WHEN here.trading AND here.c IS NOT NULL AND minute >= 960 AND printf('%02d:%02d', minute // 60, minute % 60) >= here.c THEN today ELSE CASE WHEN past.day >= today - 30 THEN past.day END END WHEN t.trading AND (manual < today OR manual = today AND t.c IS NOT NULL AND minute >= 960 AND printf('%02d:%02d', minute // 60, minute % 60) >= t.c) THEN manual END AS day
FROM asks AS a LEFT JOIN tab AS t ON t.day = a.manual LEFT JOIN tab AS here ON here.day = a.today ASOF LEFT JOIN (SELECT * FROM tab WHERE trading) AS past ON a.today > past.day))""",
       *SESSIONS, "asks AS MATERIALIZED (" + ASKS.format(date="CAST(o_orderdate AS DATE)", later="CAST(o_orderdate AS DATE) + 1", earlier="CAST(o_orderdate AS DATE) - CAST(o_custkey % 40 AS INT)") + ")")
def analysis_dates(m):
    """For every order the session of a scan at its date and a minute of that day, some for a date asked for by hand."""
    m.spark.read.parquet(f"{m.dir}/orders.parquet").createOrReplaceTempView("tidemark_orders")
    asks = m.spark.sql(ASKS.format(date="to_date(o_orderdate)", later="date_add(to_date(o_orderdate), 1)", earlier="date_sub(to_date(o_orderdate), CAST(o_custkey % 40 AS INT))").replace("FROM orders", "FROM tidemark_orders"))
    now = F.to_utc_timestamp(F.timestamp_micros((F.unix_date("today") * 1440 + F.col("minute")) * 60_000_000), ses.ZONE)
    found = ses.analysis_dates(asks.select("ask", now.alias("now"), "manual"), ses.session_table(m.calendar, _facts(m)))
    return found.select("ask", "analysis_date", "mode", "error")


@query("SELECT CAST(3050 AS BIGINT) AS sessions, (SELECT min(session_date) FROM cal) AS start, (SELECT session_date FROM cal WHERE session_no = (SELECT max(session_no) FROM cal WHERE session_date <= DATE '2001-06-15') - 800) AS start_short")
def warmup_window(m):
    c, day = m.calendar, dt.date(2001, 6, 15)
    return m.spark.createDataFrame([(cal.required_warmup(), cal.warmup_start(c, day, cal.required_warmup()), cal.warmup_start(c, day, 800))], "sessions long, start date, start_short date")


FOLDS = """folds AS MATERIALIZED (SELECT CAST(i + 1 AS BIGINT) AS fold, CAST(a + to_years(i) AS DATE) AS train_start, CAST(a + to_years(i + 3) AS DATE) AS train_end, CAST(a + to_years(i + 3) AS DATE) AS test_start, least(CAST(a + to_years(i + 4) AS DATE), b) AS test_end
FROM (SELECT min(session_date) AS a, max(session_date) AS b FROM bars), (SELECT CAST(x AS INT) AS i FROM range(200) AS g(x)) WHERE a + to_years(i + 3) < b)"""


def _folds(m):
    """Folds over all bars, from the first session to the last."""
    first, last = m.kept.agg(F.min("session_date"), F.max("session_date")).first()
    return research.fold_table(m.spark, first, last)


@query("SELECT * FROM folds", FOLDS)
def walk_forward_folds(m):
    return _folds(m)


@query("SELECT x.symbol, cal.session_date FROM (SELECT symbol, min(session_date) AS a, max(session_date) AS b FROM bars GROUP BY 1) AS x JOIN cal ON cal.session_date BETWEEN a AND b LEFT JOIN bars USING (symbol, session_date) WHERE bars.close IS NULL")
def missing_sessions(m):
    return joins.missing_sessions(m.bars, m.calendar)


@query("SELECT DISTINCT session_date FROM bars")
def universe_dates(m):
    return m.bars.select("session_date").distinct()


@query(f"SELECT symbol, week, {R('open', 'high', 'low', 'close', 'volume')}, week_end, expected_week_end FROM weekly")
def weekly_bars(m):
    return joins.weekly_bars(m.bars, cal.expected_week_ends(m.calendar)).select("symbol", "week", "open", "high", "low", "close", "volume", "week_end", "expected_week_end")


@query(f"SELECT symbol, session_date, {R(*EMAS)} FROM d0")
def ema_daily(m):
    return kernels.with_recursions(m.kept, CFG.ema.periods).select(*KEY, *EMAS)


@query("SELECT symbol, session_date, round(v, 6) AS ema FROM o JOIN b USING (symbol, rn)", "o AS (SELECT symbol, rn, close AS v FROM b WHERE rn = 1 UNION ALL SELECT o.symbol, o.rn + 1, (b.close - o.v) * (CAST(2 AS DOUBLE) / 21) + o.v FROM o JOIN b ON b.symbol = o.symbol AND b.rn = o.rn + 1)")
def ema_first_obs(m):
    return kernels.with_recursions(m.kept, {"ema": 20}, "first_obs").select(*KEY, "ema")


@query(f"SELECT symbol, week_end, {R(*[e + '_W' for e in EMAS])} FROM w")
def ema_weekly(m):
    return fts.weekly_context(m.kept, m.sessions, CFG).select("symbol", "week_end", *fts.WEEKLY_EMAS)


@query(f"SELECT symbol, session_date, round(ATR14, 6) AS ATR14, round(ATR14 / close * 100, 6) AS ATR_Pct, {', '.join(f'round((close - {e}) / ATR14, 6) AS Distance_to_{e}_ATR' for e in EMAS)} FROM d1")
def atr(m):
    return ind.with_atr_distances(m.emas).select(*KEY, "ATR14", "ATR_Pct", *[f"Distance_to_{e}_ATR" for e in EMAS])


SLOPES = [f"{e}_Slope_{x}" for e in EMAS for x in ("Pct_10D", "PerDay")]


@query(f"SELECT symbol, session_date, {R(*SLOPES)} FROM d6")
def ema_slopes(m):
    return ind.with_slopes(m.emas).select(*KEY, *SLOPES)


CROSSES = [f"{d}_X_{ind.short(a)}_{ind.short(b)}" for a, b in ind.CROSS_PAIRS for d in ("BULL", "BEAR")]


@query(f"SELECT symbol, session_date, {', '.join(CROSSES)} FROM d3")
def crossovers(m):
    return ind.with_crossovers(m.emas).select(*KEY, *CROSSES)


@query("SELECT symbol, session_date, Daily_State FROM d3")
def alignment_state(m):
    return ind.with_alignment(m.emas).select(*KEY, "Daily_State")


@query(f"SELECT symbol, session_date, {R('Cluster_Width_Pct', 'Cluster_Center', 'Cluster_Max', 'Cluster_Min')}, round((EMA10 - EMA20) / close * 100, 6) AS Dist_EMA10_EMA20_Pct, round((EMA20 - EMA89) / close * 100, 6) AS Dist_EMA20_EMA89_Pct, round((EMA89 - EMA200) / close * 100, 6) AS Dist_EMA89_EMA200_Pct, round((EMA10 - EMA200) / close * 100, 6) AS Dist_EMA10_EMA200_Pct FROM d3")
def cluster_metrics(m):
    return ind.with_cluster(m.emas).select(*KEY, "Cluster_Width_Pct", "Cluster_Center", "Cluster_Max", "Cluster_Min", *[f"Dist_{x}_Pct" for x in ("EMA10_EMA20", "EMA20_EMA89", "EMA89_EMA200", "EMA10_EMA200")])


@query(f"SELECT symbol, session_date, {R('Cluster_Width_Percentile')}, Cluster_Compressed_Flag, Cluster_ExpandedRegime_Flag FROM d6")
def cluster_percentile(m):
    return ind.with_compression(ind.with_cluster(m.emas)).select(*KEY, "Cluster_Width_Percentile", "Cluster_Compressed_Flag", "Cluster_ExpandedRegime_Flag")


@query(f"SELECT symbol, session_date, {R('Cluster_Width_Change_1D', 'Cluster_Width_Change_5D', 'Cluster_Width_Slope')}, Cluster_Expansion_State FROM d6")
def cluster_expansion(m):
    return ind.with_expansion(ind.with_cluster(m.emas)).select(*KEY, "Cluster_Width_Change_1D", "Cluster_Width_Change_5D", "Cluster_Width_Slope", "Cluster_Expansion_State")


DEFS = ["DefA_SequentialCrossover", "DefB_AlignmentTransition", "DefC_PriceThroughCluster", "DefD_CompressionExpansion"]
for _d in DEFS:

    @query(f"SELECT symbol, session_date FROM d7 WHERE {_d}", name=f"def_{_d[3].lower()}")
    def _definition(m, d=_d):
        return m.features.where(d).select(*KEY)


@query("SELECT symbol, session_date, Is_Swing_Low, Is_Swing_High FROM d7")
def swing_points(m):
    return ind.with_swings(m.bars).select(*KEY, "Is_Swing_Low", "Is_Swing_High")


@query(f"""SELECT symbol, session_date, {R('Swing_Low_Stop', 'Swing_High_Stop')}, Confirmed_Swing_Low_Date, Confirmed_Swing_Low_Available_Date, round((close - Swing_Low_Stop) / close * 100, 6) AS Stop_Distance_Pct_Long, round((close - Swing_Low_Stop) / ATR14, 6) AS Stop_Distance_ATR_Long, round(close - 2.5 * ATR14, 6) AS ATR_Based_Stop_Long,
round((Swing_High_Stop - close) / close * 100, 6) AS Stop_Distance_Pct_Short, round((Swing_High_Stop - close) / ATR14, 6) AS Stop_Distance_ATR_Short, round(close + 2.5 * ATR14, 6) AS ATR_Based_Stop_Short FROM d9""")
def swing_stops(m):
    return ind.with_stops(ind.with_swings(m.emas)).select(*KEY, "Swing_Low_Stop", "Swing_High_Stop", "Confirmed_Swing_Low_Date", "Confirmed_Swing_Low_Available_Date", *[f"{x}_{s}" for s in ("Long", "Short") for x in ("Stop_Distance_Pct", "Stop_Distance_ATR", "ATR_Based_Stop")])


@query(f"SELECT l.symbol, swing_low_date, round(swing_low, 6) AS swing_low, swing_high_date, round(swing_high, 6) AS swing_high FROM (SELECT DISTINCT symbol FROM bars) AS s JOIN (SELECT symbol, max(sld) AS swing_low_date, arg_max(sl, sld) AS swing_low FROM d8 WHERE session_date <= DATE '{ANALYSIS}' AND sl IS NOT NULL GROUP BY 1) AS l USING (symbol) JOIN (SELECT symbol, arg_max(sh, session_date) AS swing_high, max(session_date) AS at FROM d8 WHERE session_date <= DATE '{ANALYSIS}' AND sh IS NOT NULL GROUP BY 1) AS h USING (symbol) JOIN (SELECT symbol, session_date AS at, lag(session_date, 5) OVER (PARTITION BY symbol ORDER BY session_date) AS swing_high_date FROM d8) AS x ON x.symbol = h.symbol AND x.at = h.at")
def swings_as_of(m):
    return ind.swings_as_of(ind.with_swings(m.bars), ANALYSIS)


@query("SELECT symbol, session_date, Pullback_State FROM d8")
def pullback_state(m):
    return ind.with_pullback(ind.with_cluster(m.emas)).select(*KEY, "Pullback_State")


@query(f"SELECT symbol, session_date, Weekly_Period_End, {R(*[e + '_W' for e in EMAS])}, Weekly_Availability_Date FROM d2")
def weekly_asof(m):
    weekly = fts.weekly_context(m.kept, m.sessions, CFG)
    known = weekly.select("symbol", F.col("week_end").alias("Weekly_Period_End"), *fts.WEEKLY_EMAS, F.col("expected_week_end").alias("Weekly_Availability_Date"))
    return joins.asof(m.kept, known, "Weekly_Availability_Date", ["Weekly_Period_End", *fts.WEEKLY_EMAS, "Weekly_Availability_Date"]).select(*KEY, "Weekly_Period_End", *fts.WEEKLY_EMAS, "Weekly_Availability_Date")


@query(f"SELECT symbol, max(week_end) AS week_end, round(arg_max(close, expected_week_end), 6) AS close FROM weekly WHERE expected_week_end <= DATE '{ANALYSIS}' GROUP BY 1")
def weekly_as_of_date(m):
    return joins.weekly_as_of(joins.weekly_bars(m.bars, cal.expected_week_ends(m.calendar)), ANALYSIS).select("symbol", "week_end", "close")


@query("SELECT symbol, session_date, Weekly_State, Daily_State, MTF_State FROM d4")
def mtf_matrix(m):
    return m.features.select(*KEY, "Weekly_State", "Daily_State", "MTF_State")


@query(f"SELECT session_date, {R('index_close', 'Index_EMA20', 'Index_EMA50', 'Index_EMA89', 'Index_EMA200')}, Market_Regime FROM regime")
def market_regime(m):
    return fts.market_regime(m.kept_index, CFG)


@query("SELECT symbol, session_date, Market_Regime, round(index_close, 6) AS index_close FROM d2")
def regime_asof(m):
    return joins.asof_series(m.bars, fts.market_regime(m.kept_index, CFG), ["Market_Regime", "index_close"], m.calendar).select(*KEY, "Market_Regime", "index_close")


def _with_index(m):
    return joins.asof_series(m.bars, m.index.select("session_date", F.col("close").alias("index_close")), ["index_close"], m.calendar)


@query(f"SELECT symbol, session_date, {R('RS_20D', 'RS_60D', 'RS_120D')} FROM d10")
def relative_strength(m):
    return ind.with_relative_strength(_with_index(m)).select(*KEY, "RS_20D", "RS_60D", "RS_120D")


@query(f"SELECT symbol, session_date, {R('RS_60D', 'RS_Percentile')} FROM scored")
def rs_percentile(m):
    return ind.rs_percentile(ind.with_relative_strength(_with_index(m))).select(*KEY, "RS_60D", "RS_Percentile")


LIQ = ["Volume20", "Volume50", "Volume_Ratio", "Traded_Value", "Average_Daily_Traded_Value"]


@query(f"SELECT symbol, session_date, {R(*LIQ)} FROM d11")
def liquidity(m):
    return ind.with_liquidity(m.bars).select(*KEY, *LIQ)


@query("SELECT symbol, session_date FROM d11 WHERE close >= 1500 AND coalesce(Average_Daily_Traded_Value, 0) >= 200000 AND coalesce(Volume20, 0) >= 120")
def liquidity_filter(m):
    return ind.liquid(ind.with_liquidity(m.bars), 1500, 200_000, 120).select(*KEY)


@query(f"SELECT symbol, session_date, {', '.join(ind.ENTRIES.values())}, Any_Entry_Triggered FROM d11")
def entries_a_e(m):
    return m.features.select(*KEY, *ind.ENTRIES.values(), "Any_Entry_Triggered")


@query("SELECT symbol, session_date, Signal_State, Price_vs_EMA200, EMA89_vs_EMA200, EMA200_Rising FROM f")
def signal_state(m):
    return m.features.select(*KEY, "Signal_State", "Price_vs_EMA200", "EMA89_vs_EMA200", "EMA200_Rising")


@query("SELECT symbol, session_date, was || ' -> ' || Daily_State AS change FROM (SELECT *, lag(Daily_State) OVER (PARTITION BY symbol ORDER BY session_date) AS was FROM d3) WHERE was IS NOT NULL AND Daily_State IS NOT NULL AND was <> Daily_State")
def state_changes(m):
    return ind.state_changes(ind.with_alignment(m.emas))


@query("SELECT symbol, session_date, round(close, 6) AS close, Daily_State, Signal_State, CASE WHEN close > Cluster_Center THEN 'ABOVE' ELSE 'BELOW' END AS side FROM f WHERE Cluster_Center IS NOT NULL")
def diagnostics_rows(m):
    return m.features.where("Cluster_Center IS NOT NULL").select(*KEY, "close", "Daily_State", "Signal_State", F.when(F.col("close") > F.col("Cluster_Center"), "ABOVE").otherwise("BELOW").alias("side"))


SCORES = ["Trend_Alignment_Score", "MultiTimeframe_Score", "Cluster_Expansion_Score", "Momentum_Score", "RelativeStrength_Score", "Liquidity_Score", "Pullback_Quality_Score"]


@query(f"SELECT symbol, session_date, {', '.join(f'round(CAST(s{i} AS DOUBLE), 6) AS {s}' for i, s in enumerate(SCORES, 1))}, round(score, 6) AS Research_Rank_Score FROM scored")
def score_components(m):
    return ind.with_scores(m.features).select(*KEY, *SCORES, "Research_Rank_Score")


REASON = """concat_ws(' ', CASE Daily_State WHEN 'BULLISH_ALIGNED' THEN 'Daily EMA structure is bullish (EMA10>EMA20>EMA89>EMA200).' WHEN 'BEARISH_ALIGNED' THEN 'Daily EMA structure is bearish (EMA10<EMA20<EMA89<EMA200).' ELSE 'Daily EMA structure is mixed / not fully aligned.' END,
CASE Weekly_State WHEN 'BULLISH_ALIGNED' THEN 'Weekly EMA structure is also bullish.' WHEN 'BEARISH_ALIGNED' THEN 'Weekly EMA structure is bearish.' END, CASE Cluster_Expansion_State WHEN 'EXPANDING' THEN 'EMA cluster width is expanding.' WHEN 'CONTRACTING' THEN 'EMA cluster is compressing.' END,
CASE WHEN Price_vs_EMA200 THEN 'Price is above EMA200.' ELSE 'Price is below EMA200.' END, CASE WHEN RS_60D IS NOT NULL THEN '60-day relative strength vs index is ' || CASE WHEN RS_60D > 0 THEN 'positive' ELSE 'negative' END || printf(' (%.1f%%).', RS_60D) END,
CASE WHEN Pullback_State IN ('SHALLOW_PULLBACK', 'MODERATE_PULLBACK') THEN 'Stock is in a ' || lower(replace(Pullback_State, '_', ' ')) || ' toward the EMA cluster.' END, CASE WHEN EntryD_SwingHighBreakout THEN 'A confirmed break of the most recent swing high has occurred.' END)"""


@query(f"SELECT symbol, session_date, {REASON} AS Signal_Reason FROM f")
def signal_reason(m):
    return m.features.select(*KEY, ind.signal_reason().alias("Signal_Reason"))


SCAN = f"""SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, symbol) AS Rank_ID, symbol AS Symbol, session_date AS Analysis_Date, Signal_State, round(EMA200, 6) AS Daily_EMA200, MTF_State, round(RS_Percentile, 6) AS RS_Percentile, told AS Entry_Models_Triggered, round(close, 6) AS Signal_Close, due AS Next_Session_Date,
CASE WHEN nxt = due THEN round(nopen, 6) END AS Execution_Reference, round(Swing_Low_Stop, 6) AS Stop_Reference, CASE WHEN Swing_Low_Stop IS NOT NULL THEN Swing_Low_Stop < close END AS Risk_Geometry_Valid, round(score, 6) AS Research_Rank_Score
FROM (SELECT *, lead(open) OVER (PARTITION BY symbol ORDER BY session_date) AS nopen FROM scored) WHERE session_date = DATE '{ANALYSIS}'"""
SCAN_COLUMNS = ["Rank_ID", "Symbol", "Analysis_Date", "Signal_State", "Daily_EMA200", "MTF_State", "RS_Percentile", "Entry_Models_Triggered", "Signal_Close", "Next_Session_Date", "Execution_Reference", "Stop_Reference", "Risk_Geometry_Valid", "Research_Rank_Score"]


def _scan(m):
    return scan.scan_tables(scan.scan_rows(m.features, m.sessions, ANALYSIS, CFG))


@query(SCAN)
def scan_universe(m):
    return _scan(m)["universe_diagnostics"].select(*SCAN_COLUMNS)


@query(f"SELECT * FROM ({SCAN}) WHERE Entry_Models_Triggered IS NOT NULL")
def scan_signals(m):
    return _scan(m)["signals"].select(*SCAN_COLUMNS)


@query(f"SELECT * FROM ({SCAN}) WHERE Entry_Models_Triggered IS NULL AND Signal_State IN ('WATCH', 'TREND_FORMING', 'BULLISH_CLUSTER', 'PULLBACK')")
def scan_candidates(m):
    return _scan(m)["candidates"].select(*SCAN_COLUMNS)


@query("SELECT symbol FROM (SELECT DISTINCT symbol FROM bars) ORDER BY symbol LIMIT 3")
def universe_limit(m):
    return scan.first_symbols(m.bars.select("symbol").distinct(), 3)


for _m, _p in (("same_close", "close"), ("next_open", "open"), ("next_close", "close")):
    _same = _m == "same_close"

    @query(f"SELECT symbol, session_date, {'session_date' if _same else 'due'} AS execution_date, CASE WHEN {'true' if _same else 'nxt = due'} THEN round({_p if _same else 'np'}, 6) END AS execution_price, CASE WHEN {'true' if _same else 'nxt = due'} THEN 'OK' ELSE 'DATA_GAP' END AS execution_status FROM (SELECT *, lead({_p}) OVER (PARTITION BY symbol ORDER BY session_date) AS np FROM d11)", name=f"execution_{_m}")
    def _execution(m, model=_m):
        return joins.with_execution(m.bars, m.calendar, model).select(*KEY, "execution_date", "execution_price", "execution_status")


EVENT = ["symbol", "entry_model", "entry_model_label", "signal_date", "execution_date", "entry_price", "mfe_pct", "mae_pct", "time_to_mfe", "time_to_mae", "market_regime", *[f"fwd_ret_{h}d{n}" for h in evs.HORIZONS for n in ("", "_net")]]
EVENT_SQL = ", ".join(f"round({c}, 6) AS {c}" if c in ("entry_price", "mfe_pct", "mae_pct") or c.startswith("fwd") else c for c in EVENT)


@query(f"SELECT {EVENT_SQL} FROM ev", *events_sql("OPEN"))
def event_forward_returns(m):
    return evs.event_study(m.features, m.sessions, CFG).select(*EVENT)


@query(f"SELECT {EVENT_SQL} FROM ev", *events_sql("CLOSE"))
def event_forward_returns_close(m):
    from dataclasses import replace

    return evs.event_study(m.features, m.sessions, replace(CFG, execution_model="next_close")).select(*EVENT)


@query(f"SELECT entry_model, {stats_sql('fwd_ret_20d')}, {stats_sql('fwd_ret_20d_net', 'net_')}, round(avg(mfe_pct), 6) AS avg_mfe_pct, round(avg(mae_pct), 6) AS avg_mae_pct FROM ev GROUP BY 1", *events_sql())
def comparison_table(m):
    return evs.comparison_table(evs.event_study(m.features, m.sessions, CFG))


@query(f"SELECT entry_model, market_regime, {stats_sql('fwd_ret_20d')} FROM ev WHERE market_regime IS NOT NULL GROUP BY 1, 2", *events_sql())
def regime_breakdown(m):
    return evs.regime_breakdown(evs.event_study(m.features, m.sessions, CFG))


@query("SELECT entry_model, symbol, count(*) AS n_events, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY entry_model), 6) AS share_pct FROM ev GROUP BY 1, 2", *events_sql())
def concentration(m):
    return evs.concentration(evs.event_study(m.features, m.sessions, CFG))


@query(" UNION ALL ".join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, count(*) AS n FROM f WHERE {a} AND {b}" for i, a in enumerate(ind.ENTRIES.values()) for b in list(ind.ENTRIES.values())[i + 1 :]))
def signal_overlap(m):
    return evs.signal_overlap(m.features)


@query(f"SELECT {stats_sql('r')} FROM (SELECT (close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date) - 1) * 100 AS r FROM bars)")
def performance_stats(m):
    r = (F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("session_date")) - 1) * 100
    return m.bars.select(r.alias("r")).agg(*stats.performance(F.col("r")))


@query(f"SELECT symbol, {stats_sql('r')} FROM (SELECT symbol, (close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date) - 1) * 100 AS r FROM bars) GROUP BY 1")
def performance_stats_by_group(m):
    r = (F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("session_date")) - 1) * 100
    return stats.performance_by(m.bars.select("symbol", r.alias("r")), "r", "symbol")


@query("""SELECT n AS n_sessions, round((pow(fin / ini, 1.0 / years) - 1) * 100, 6) AS cagr_pct, round(sd * sqrt(252) * 100, 6) AS annualized_volatility_pct, round(mu * 252 / (sd * sqrt(252)), 6) AS sharpe, round(mu * 252 / (dn * sqrt(252)), 6) AS sortino, round((pow(fin / ini, 1.0 / years) - 1) * 100 / abs(mdd), 6) AS calmar,
round(mdd, 6) AS max_drawdown_pct, run AS max_drawdown_duration_sessions, round(expo, 6) AS avg_exposure_pct, round(fin, 6) AS final_equity, round(ini, 6) AS initial_equity FROM (SELECT count(*) AS n, date_diff('day', min(session_date), max(session_date)) / 365.25 AS years, avg(r) AS mu, stddev_samp(r) AS sd, stddev_samp(r) FILTER (WHERE r < 0) AS dn, min(dd) AS mdd,
arg_max(equity, session_date) AS fin, arg_min(equity, session_date) AS ini, 25.0 AS expo FROM q), (SELECT max(c) AS run FROM (SELECT count(*) FILTER (WHERE dd < -1e-9) AS c FROM (SELECT *, sum(CAST(dd >= -1e-9 AS INT)) OVER (ORDER BY session_date) AS island FROM q) GROUP BY island))""",
       "q AS MATERIALIZED (SELECT session_date, close AS equity, close / lag(close) OVER (ORDER BY session_date) - 1 AS r, (close / max(close) OVER (ORDER BY session_date) - 1) * 100 AS dd FROM index_bars)")
def portfolio_stats(m):
    curve = m.index.select("session_date", F.col("close").alias("equity"), (F.col("close") / 4).alias("positions_value"))
    return stats.portfolio_stats(curve).drop("risk_free_rate_annual", "mar_annual")


@query("SELECT symbol, session_date, round(factor, 6) AS factor, round(open * factor, 6) AS open, round(high * factor, 6) AS high, round(low * factor, 6) AS low, round(close * factor, 6) AS close, round(volume / factor, 6) AS volume FROM (SELECT *, CASE WHEN rn < 700 THEN 0.1 WHEN rn < 1400 THEN 0.2 ELSE 1.0 END AS factor FROM b)")
def split_adjusted(m):
    f = prices.split_factors(m.raw).select(*KEY, "factor")
    return prices.adjusted(m.raw).join(f, KEY).select(*KEY, "factor", "open", "high", "low", "close", "volume")


@query("SELECT symbol, session_date, round(close * CASE WHEN rn < 700 AND s <= DATE '1998-01-01' THEN 0.5 ELSE 1.0 END, 6) AS close FROM b JOIN (SELECT symbol, session_date AS s FROM b WHERE rn = 700) USING (symbol)")
def split_point_in_time(m):
    return prices.adjusted(m.raw, as_of="1998-01-01").select(*KEY, "close")


@query("SELECT symbol, session_date, round(close, 6) AS total_return_close FROM bars")
def total_return(m):
    return prices.total_return_close(m.raw)


@query(f"""SELECT symbol, n AS rows, first_date, last_date, CAST(0 AS BIGINT) AS duplicate_dates, CAST(0 AS BIGINT) AS non_finite, jumps, CAST(upto - last_no AS BIGINT) AS stale_sessions, last_no - first_no + 1 - n AS missing_sessions, today > 0 AS has_analysis_date, 'WARN' AS status, today > 0 AS eligible FROM (
SELECT symbol, count(*) AS n, min(session_date) AS first_date, max(session_date) AS last_date, count(*) FILTER (WHERE r > 0.3) AS jumps, max(session_no) AS last_no, min(session_no) AS first_no, count(*) FILTER (WHERE session_date = DATE '{ANALYSIS}') AS today FROM (SELECT *, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY session_date) - 1) AS r FROM bars WHERE session_date <= DATE '{ANALYSIS}') JOIN cal USING (session_date) GROUP BY 1), (SELECT max(session_no) AS upto FROM cal WHERE session_date <= DATE '{ANALYSIS}')""")
def quality_report(m):
    past = m.bars.where(F.col("session_date") <= F.lit(ANALYSIS).cast("date"))
    return checks.quality_report(past, m.calendar, ANALYSIS).select("symbol", "rows", "first_date", "last_date", "duplicate_dates", "non_finite", "jumps", F.col("stale_sessions").cast("long").alias("stale_sessions"), F.col("missing_sessions").cast("long").alias("missing_sessions"), "has_analysis_date", "status", "eligible")


@query("SELECT 'WARN' AS status, count(DISTINCT symbol) AS symbols FROM bars")
def quality_tally(m):
    return checks.tally(checks.quality_report(m.bars, m.calendar, ANALYSIS))


@query("""PLAIN SELECT event_type AS symbol, 'a time of day in the date' AS issue, count(*) AS rows FROM events WHERE ts <> date_trunc('day', ts) GROUP BY 1 UNION ALL SELECT NULL, x, NULL FROM (VALUES ('missing column high'), ('missing column low'), ('close is no number but string')) AS t(x)""")
def bar_contract(m):
    """The form of bars, asked of events, which aren't any."""
    rows = m.spark.read.parquet(f"{m.dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("session_date"), F.col("value").alias("open"), F.col("props").alias("close"), F.col("user_id").alias("volume"))
    return checks.contract(rows)


@query("""SELECT r.symbol, coalesce(n, 0) AS rows, CASE WHEN n > 0 THEN 'ELIGIBLE' ELSE 'EXCLUDED' END AS status, x - coalesce(n, 0) AS missing, round(coalesce(n, 0) * 100.0 / x, 6) AS coverage_pct FROM (SELECT DISTINCT symbol FROM bars UNION ALL SELECT 'NOSUCH') AS r LEFT JOIN (SELECT symbol, count(*) AS n FROM bars WHERE session_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY 1) USING (symbol),
(SELECT count(*) AS x FROM cal WHERE session_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31')""")
def data_audit(m):
    asked = m.bars.select("symbol").distinct().unionByName(m.spark.sql("SELECT 'NOSUCH' AS symbol"))
    return checks.data_audit(asked, m.bars, m.calendar, "1999-01-01", "2000-12-31").select("symbol", F.col("rows").cast("long").alias("rows"), "status", "missing", "coverage_pct")


@query("""SELECT symbol, session_date, field, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(abs(value_a - value_b) / value_a * 100, 6) AS diff_pct, CASE WHEN abs(value_a - value_b) / value_a * 100 < 0.5 THEN 'MATCH' ELSE 'DIFFERS' END AS status FROM (
SELECT symbol, session_date, unnest(['open', 'high', 'low', 'close']) AS field, unnest([open, high, low, close]) AS value_a, unnest([open * 1.004, high * 1.006, low, close * 0.99]) AS value_b FROM bars)""")
def cross_check(m):
    other = m.bars.withColumns({"open": F.col("open") * 1.004, "high": F.col("high") * 1.006, "close": F.col("close") * 0.99})
    return joins.cross_check(m.bars, other).select(*KEY, "field", "value_a", "value_b", "diff_pct", "status")


@query("""SELECT d.security_id, d.date, h.symbol FROM (SELECT DISTINCT user_id AS security_id, CAST(ts AS DATE) + CAST(event_id % 9 AS INT) - 4 AS date FROM events) AS d
LEFT JOIN (SELECT *, lead(valid_from) OVER (PARTITION BY security_id ORDER BY valid_from) - 1 AS until FROM (SELECT user_id AS security_id, CAST(ts AS DATE) AS valid_from, max(event_type) AS symbol FROM events GROUP BY 1, 2)) AS h ON h.security_id = d.security_id AND d.date >= valid_from AND d.date <= coalesce(until, DATE '9999-12-31')""")
def security_master(m):
    """What each user's last event was called, as a history of symbols, at dates around every event."""
    events = m.spark.read.parquet(f"{m.dir}/events.parquet").select(F.col("user_id").alias("security_id"), F.to_date("ts").alias("valid_from"), F.col("event_type").alias("symbol"), "event_id")
    names = events.groupBy("security_id", "valid_from").agg(F.max("symbol").alias("symbol"))
    history = names.withColumn("valid_to", F.date_sub(F.lead("valid_from").over(Window.partitionBy("security_id").orderBy("valid_from")), 1))
    dates = events.select("security_id", F.date_add("valid_from", (F.col("event_id") % 9 - 4).cast("int")).alias("date"))
    return joins.symbol_as_of(dates, history)


@query("""SELECT symbol, session_date, CAST(CASE WHEN NOT (stop < close) THEN 0 ELSE floor(1e6 * 0.005 / abs(close - stop)) END AS BIGINT) AS qty, CASE WHEN NOT (stop < close) THEN 'invalid_risk_geometry' WHEN floor(1e6 * 0.005 / abs(close - stop)) < 1 THEN 'below_min_qty' ELSE 'ok' END AS reason FROM (SELECT *, (low + open) / 2 AS stop FROM bars)""")
def position_sizing(m):
    sized = costs.position_size(F.lit(1e6), F.col("close"), (F.col("low") + F.col("open")) / 2)
    return m.bars.select(*KEY, sized.alias("s")).select(*KEY, "s.qty", "s.reason")


_LEG = "m * (0.03 + 0.10 + 0.00345 + (0.03 + 0.00345) * 0.18 + 0.05) / 100"


@query(f"""SELECT symbol, scenario, round(v, 6) AS turnover, round(v * {_LEG}, 6) AS buy, round(v * {_LEG}, 6) AS sell, round(v * 2 * {_LEG}, 6) AS round_trip FROM (SELECT symbol, avg(close * volume) AS v FROM bars GROUP BY 1), (VALUES ('zero_cost', CAST(0 AS DOUBLE)), ('low_cost', 0.5), ('base_cost', 1), ('high_cost', 2), ('stress_cost', 3)) AS t(scenario, m)""")
def cost_scenarios(m):
    """What it costs, in each scenario, to trade what is traded of each symbol on a mean day."""
    traded = m.bars.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("turnover"))
    legs = m.spark.createDataFrame(evs.costs_table(), "scenario string, b double, s double, r double")  # five rows
    return traded.crossJoin(F.broadcast(legs)).select("symbol", "scenario", "turnover", *[(F.col("turnover") * F.col(c)).alias(name) for c, name in (("b", "buy"), ("s", "sell"), ("r", "round_trip"))])


@query(f"SELECT CAST(fold AS BIGINT) AS fold, entry_model, {stats_sql('fwd_ret_20d')} FROM ev GROUP BY 1, 2", FOLDS, "inside AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY fold, symbol) AS k FROM f JOIN folds ON session_date >= test_start AND session_date < test_end) WHERE k > 30)", *events_sql("OPEN", "inside", "fold, symbol"))
def walk_forward_mode1(m):
    return research.walk_forward_fixed(m.features, m.sessions, _folds(m), CFG).drop("mode", "test_start", "test_end")


COMBOS = [(10, 20, 89, n) for n in (180, 200, 220)]
_EVERY = " UNION ALL ".join(f"SELECT {i} AS cell, * FROM (WITH RECURSIVE {', '.join(steps(dict(zip(EMAS, c))))} SELECT * FROM f)" for i, c in enumerate(COMBOS))
_WITHIN = "WITH inside AS MATERIALIZED (SELECT * FROM every JOIN folds ON session_date >= {0}_start AND session_date < {0}_end), " + ", ".join(events_sql("OPEN", "inside", "fold, cell, symbol")).replace("{", "{{").replace("}", "}}") + " SELECT * FROM ev"
_CHOSEN = ", ".join(f"CAST(CASE cell {' '.join(f'WHEN {i} THEN {c[k]}' for i, c in enumerate(COMBOS))} END AS BIGINT) AS selected_training_{n}" for k, n in enumerate(("fast", "medium", "structural", "long")))


@query(f"SELECT CAST(fold AS BIGINT) AS fold, entry_model, {stats_sql('fwd_ret_20d')}, round(first(m), 6) AS training_window_selection_metric, {_CHOSEN}, first(test_start) AS test_start, first(test_end) AS test_end, 'TRAINED' AS mode, 'median fwd_ret_20d' AS selection_basis FROM ({_WITHIN.format('test')}) AS e JOIN best USING (fold, cell) JOIN folds USING (fold) GROUP BY fold, cell, entry_model HAVING count(fwd_ret_20d) > 5",
       FOLDS, f"every AS MATERIALIZED ({_EVERY})", f"best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY m DESC, cell) AS k FROM (SELECT fold, cell, median(fwd_ret_20d) AS m FROM ({_WITHIN.format('train')}) GROUP BY 1, 2 HAVING count(fwd_ret_20d) > 30)) WHERE k = 1)")
def walk_forward_mode2(m):
    return research.walk_forward_selected(m.kept, m.kept_index, m.sessions, _folds(m), COMBOS, CFG)


@query("PLAIN " + cells_sql(research.cells(CFG)))
def ema_sensitivity(m):
    return research.ema_sensitivity(m.kept, m.kept_index, m.sessions, CFG)


@query(f"SELECT round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS spread, arg_max(symbol, v) AS best FROM (SELECT symbol, avg(close) AS v FROM bars GROUP BY 1)")
def plateau(m):
    return research.plateau(m.bars.groupBy("symbol").agg(F.avg("close").alias("v")), "v", "symbol")


GRID_PERIODS = {f"p{n}": n for n in (8, 10, 12, 18, 20)}


@query("SELECT CAST(a AS BIGINT) AS fast, CAST(b AS BIGINT) AS slow, count(*) AS bars, count(*) FILTER (WHERE x > y) AS above, round(avg((x / y - 1) * 100), 6) AS gap_pct FROM (SELECT a, b, CASE a WHEN 8 THEN p8 WHEN 10 THEN p10 ELSE p12 END AS x, CASE b WHEN 18 THEN p18 ELSE p20 END AS y FROM gp, (VALUES (8), (10), (12)) AS f(a), (VALUES (18), (20)) AS g(b)) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2",
       recursive_ema("ge", "b", GRID_PERIODS.values()), picked("gp", "b", "ge", GRID_PERIODS))
def parameter_grid(m):
    """Every combination of two periods with its results over all bars; averages are computed once for each period."""
    cells = research.evaluate_grid(m.spark, {"fast": (8, 10, 12), "slow": (18, 20)})
    rows = kernels.with_recursions(m.kept.select("symbol", "session_date", "close"), GRID_PERIODS)
    of = lambda c: F.element_at(F.create_map(*[x for k, n in GRID_PERIODS.items() for x in (F.lit(n), F.col(k))]), F.col(c).cast("int"))
    both = rows.crossJoin(F.broadcast(cells)).select("fast", "slow", of("fast").alias("x"), of("slow").alias("y")).dropna()  # six cells
    return both.groupBy("fast", "slow").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("x") > F.col("y")).alias("above"), F.avg((F.col("x") / F.col("y") - 1) * 100).alias("gap_pct"))


SCENARIOS = {"default": {}, "fixed_20": {"exit_rule": "FIXED_HORIZON"}, "entry_a_close": {"entry_model_col": "EntryA_FreshAlignment", "execution_model": "next_close"}, "capped": {"max_concurrent_positions": 2, "max_position_pct_of_equity": 20.0, "risk_budget_basis": "CASH", "execution_model": "same_close"}}


@query()
def backtest_trades(m):
    return bt.trades(bt.run_backtests(m.features, m.sessions, CFG, SCENARIOS))


@query()
def backtest_equity(m):
    return bt.equity(bt.run_backtests(m.features, m.sessions, CFG, SCENARIOS))


@query()
def backtest_skips(m):
    return bt.skipped(bt.run_backtests(m.features, m.sessions, CFG, SCENARIOS))


@query()
def backtest_stats(m):
    result = bt.run_backtests(m.features, m.sessions, CFG, SCENARIOS)
    return stats.portfolio_stats(bt.equity(result), bt.trades(result), keys=("scenario",))


def _returns(m):
    return evs.event_study(m.features, m.sessions, CFG).select("symbol", "execution_date", "fwd_ret_20d")


@query()
def bootstrap_ticker(m):
    return stats.cluster_bootstrap(_returns(m), "fwd_ret_20d", "symbol")


@query()
def bootstrap_date(m):
    return stats.cluster_bootstrap(_returns(m), "fwd_ret_20d", "execution_date", seed=43)


@query()
def bootstrap_two_way(m):
    return stats.two_way_bootstrap(_returns(m), "fwd_ret_20d")


@query("SELECT symbol, session_date, round(CASE WHEN month(session_date) = 3 THEN close * 2 ELSE close END, 6) AS close FROM bars")
def cache_upsert(m):
    """The cache's merge: every bar, then March's bars again with twice the close, which arrived later."""
    stamp = lambda df, at: df.withColumn("ingest_ts", F.lit(at).cast("timestamp"))
    later = m.bars.where(F.month("session_date") == 3).withColumn("close", F.col("close") * 2)
    return src.merged(stamp(m.bars, "2002-01-01"), stamp(later, "2002-01-02")).select(*KEY, "close")


@query("""SELECT symbol, first_date, last_date, CASE WHEN last_date < (SELECT max(session_date) FROM cal WHERE session_date <= DATE '2001-12-31') THEN last_date - 18 END AS tail_from, CASE WHEN first_date > (SELECT min(session_date) FROM cal WHERE session_date >= DATE '1996-01-01') THEN DATE '1996-01-01' END AS head_from
FROM (SELECT symbol, min(session_date) AS first_date, max(session_date) AS last_date FROM bars WHERE session_date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' GROUP BY 1)""")
def cache_refresh(m):
    held = m.bars.where(F.col("session_date").between(F.lit("1997-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    return src.refresh_ranges(held, m.calendar, "1996-01-01", "2001-12-31").drop("refresh")


HELD = "s.session_no * 8 > n AND s.session_no * 8 <= 7 * n AND NOT (s.session_no * 2 > n AND s.session_no * 2 <= n + 40) AND b.symbol > (SELECT min(symbol) FROM bars)"


@query("""SELECT symbol, CASE WHEN held = 0 THEN 'FILLED' ELSE 'REFRESHED' END AS status, lo AS refresh_start, hi AS refresh_end, held AS rows_before, rows AS rows_after, asked AS rows_downloaded, last_held AS previous_latest_session, last AS new_latest_session, span - rows AS gaps, span = rows AS range_complete, 'HIT' AS then_status, CAST(0 AS BIGINT) AS then_downloaded
FROM (SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE held) AS held, max(session_date) FILTER (WHERE held) AS last_held, max(session_date) AS last, max(session_no) - min(session_no) + 1 AS span FROM h GROUP BY 1) JOIN (SELECT h.symbol, count(*) AS asked FROM h JOIN (SELECT symbol, max(session_date) FILTER (WHERE held) - 18 AS back FROM h GROUP BY 1) AS t USING (symbol) WHERE NOT held OR session_date >= back GROUP BY 1) USING (symbol), (SELECT min(session_date) AS lo, max(session_date) AS hi FROM cal)""",
       f"h AS MATERIALIZED (SELECT b.symbol, b.session_date, s.session_no, {HELD} AS held FROM bars AS b JOIN cal AS s USING (session_date), (SELECT max(session_no) AS n FROM cal))")
def repository_refresh(m):
    """A cache that lacks its first and last eighth, 20 sessions in the middle and one symbol is brought up to date from all bars; then once more."""
    every, calendar = stored(m.bars), stored(m.calendar)
    n, span = F.lit(calendar.count()), calendar.agg(F.min("session_date"), F.max("session_date")).first()
    no = F.col("session_no")
    held = every.join(calendar, "session_date").where((no * 8 > n) & (no * 8 <= n * 7) & ~((no * 2 > n) & (no * 2 <= n + 40)))
    held = held.join(every.agg(F.min("symbol").alias("symbol")), "symbol", "left_anti").select(every.columns)
    cache = src.BarCache(m.spark, shared_dir(m.spark))
    cache.upsert(held.withColumns({"source": F.lit("seed"), "ingest_ts": F.lit("2000-01-01").cast("timestamp")}))
    repo = rep.Repository(cache, rep.from_table(every, "orders"), calendar, "RAW")
    symbols = every.select("symbol")
    once, twice = repo.refresh(symbols, str(span[0]), str(span[1])), repo.refresh(symbols, str(span[0]), str(span[1]))
    then = twice.diagnostics.select("symbol", F.col("status").alias("then_status"), F.col("rows_downloaded").alias("then_downloaded"))
    out = once.diagnostics.withColumn("gaps", F.size("internal_gap_sessions").cast("long"))
    return out.join(then, "symbol").select("symbol", "status", "refresh_start", "refresh_end", "rows_before", "rows_after", "rows_downloaded", "previous_latest_session", "new_latest_session", "gaps", "range_complete", "then_status", "then_downloaded")


@query("SELECT symbol, session_date, round(CASE WHEN session_date = last THEN close * 2 ELSE close END, 6) AS close, date_trunc('month', session_date) = date_trunc('month', last) AS rewritten FROM bars, (SELECT max(session_date) AS last FROM cal)")
def cache_partitions(m):
    """The cache after a first write that holds every bar twice, and an upsert of the last day's bars with twice the close."""
    stamp = lambda df, at: df.withColumn("ingest_ts", F.lit(at).cast("timestamp"))
    every = stored(m.bars)
    cache = src.BarCache(m.spark, shared_dir(m.spark))
    cache.upsert(stamp(every, "2002-01-01").unionByName(stamp(every.withColumn("close", F.col("close") + 1), "2001-01-01")))
    last = every.agg(F.max("session_date").alias("session_date"))
    rows = cache.upsert(stamp(every.join(last, "session_date", "left_semi").withColumn("close", F.col("close") * 2), "2002-01-02"))
    months = [(month, folder.startswith("2-")) for month, folder in cache.manifest()["months"].items()]
    return rows.withColumn("month", F.date_format("session_date", "yyyy-MM")).join(m.spark.createDataFrame(months, "month string, rewritten boolean"), "month").select(*KEY, "close", "rewritten")


@query("SELECT symbol, count(*) AS rows, (SELECT count(*) FROM cal) - count(*) AS gaps, count(*) = (SELECT count(*) FROM cal) AS range_complete FROM bars GROUP BY 1")
def cache_coverage(m):
    return src.coverage(m.bars, m.calendar, "1990-01-01", "2010-01-01")


@query("SELECT symbol, count(*) AS n, CASE WHEN symbol < 'C' THEN 'first' ELSE 'second' END AS source FROM bars GROUP BY 1")
def provider_fallback(m):
    def gone():
        raise src.DataUnavailable("no network")

    some = m.bars.where(F.col("symbol") < "C")
    return src.first_available([("remote", gone), ("first", lambda: some), ("second", lambda: m.bars)]).groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("n"))


@query("PLAIN SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n, round(sum(value), 6) AS total, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2")
def weekly_events(m):
    """The windows of the weekly stream, over the whole table at once."""
    from .streaming.ingest import weekly_stream

    return weekly_stream(m.spark.read.parquet(f"{m.dir}/events.parquet"))


SQL["weekly_events"] = SQL["weekly_events"].replace("max(value) AS high, min(value) AS low", f"round(max(value) + {EPSILON}, 6) AS high, round(min(value) + {EPSILON}, 6) AS low")
