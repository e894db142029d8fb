"""Where bars come from: tables, files, providers in order of preference, and a cache that is brought up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .cache import SCHEMA_VERSION, BarCache, merged  # noqa: F401

BAR_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("session_date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
RAW_SCHEMA = T.StructType([*BAR_SCHEMA.fields, *[T.StructField(c, T.DoubleType()) for c in ("adj_close", "dividends", "stock_splits")], T.StructField("source", T.StringType()), T.StructField("ingest_ts", T.TimestampType())])
#: Columns of the exchange's daily file that are read; fixed values.
EXCHANGE_COLUMNS = {"TckrSymb": "symbol", "TradDt": "session_date", "OpnPric": "open", "HghPric": "high", "LwPric": "low", "ClsPric": "close", "TtlTradgVol": "volume"}


class DataUnavailable(RuntimeError):
    """A source has nothing to give; it never stands in with an empty or invented frame."""


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR_SCHEMA).parquet(path)


def finite(df: DataFrame, columns=("open", "high", "low", "close", "volume")) -> DataFrame:
    """NaN as null, so that every later rule about missing values is one about nulls."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades: symbol, session_date, price, quantity, and a struct that orders them within a day."""
    at = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = at("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.to_date("l_shipdate").alias("session_date"))
    owner = at("orders").select("o_orderkey", "o_custkey").join(at("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = lines.join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("c_mktsegment").alias("symbol"), "session_date", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))


def bars_from_trades(rows: DataFrame, keys=("symbol",)) -> DataFrame:
    """Daily bars of trades (price, quantity, seq). Combines on the map side: a hot symbol sends one row for each day."""
    return rows.groupBy(*keys, "session_date").agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("quantity").alias("volume"))


def exchange_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of series EQ from the exchange's daily files; missing columns are an error."""
    raw = spark.read.option("header", True).csv(path)
    if missing := sorted({*EXCHANGE_COLUMNS, "SctySrs"} - set(raw.columns)):
        raise DataUnavailable(f"the file lacks {missing}")
    rows = raw.where("SctySrs = 'EQ'")
    if symbol is not None:
        rows = rows.where(F.col("TckrSymb") == symbol)
    kinds = {f.name: f.dataType for f in BAR_SCHEMA}
    return rows.select(*[F.trim(F.col(k)).cast(kinds[v]).alias(v) for k, v in EXCHANGE_COLUMNS.items()])


def first_available(sources: list[tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """Each symbol from the first source that has it, with the source's name. Sources that raise DataUnavailable are
    passed over; if all do, so does this."""
    found, why = [], []
    for priority, (name, open_) in enumerate(sources):
        try:
            found.append(open_().withColumns({"source": F.lit(name), "_priority": F.lit(priority)}))
        except DataUnavailable as e:
            why.append(f"{name}: {e}")
    if not found:
        raise DataUnavailable("; ".join(why))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    best = rows.groupBy("symbol").agg(F.min("_priority").alias("_priority"))
    return rows.join(best, ["symbol", "_priority"], "left_semi").drop("_priority")


def build_sources(spark: SparkSession, paths: dict[str, str]) -> list[tuple[str, Callable[[], DataFrame]]]:
    """Named landing zones as sources; a path without data is one that has nothing to give."""

    def opened(path: str) -> Callable[[], DataFrame]:
        def open_() -> DataFrame:
            try:
                df = read(spark, path)
                if df.isEmpty():
                    raise DataUnavailable(f"{path} is empty")
                return df
            except AnalysisException as e:
                raise DataUnavailable(f"{path} can't be read") from e

        return open_

    return [(name, opened(path)) for name, path in dict(paths).items()]


def refresh_ranges(cached: DataFrame, calendar: DataFrame, start: str, end: str, overlap: int = 10) -> DataFrame:
    """What to fetch for each symbol so that its cache covers start..end: a tail from `overlap` sessions before its last
    bar, a head before its first, or nothing (HIT)."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    sessions = calendar.where(F.col("session_date").between(a, b)).agg(F.min("session_date").alias("_a"), F.max("session_date").alias("_b"))
    held = cached.groupBy("symbol").agg(F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"))
    x = held.crossJoin(F.broadcast(sessions))  # one row
    tail = F.when(F.col("last_date") < F.col("_b"), F.date_sub(F.col("last_date"), int(overlap * 1.5) + 3))
    head = F.when(F.col("first_date") > F.col("_a"), a)
    return x.select("symbol", "first_date", "last_date", tail.alias("tail_from"), head.alias("head_from"), F.when(tail.isNull() & head.isNull(), "HIT").when(tail.isNotNull() & head.isNotNull(), "BOTH").when(tail.isNotNull(), "TAIL").otherwise("HEAD").alias("refresh"))


def coverage(cached: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Per symbol rows, the sessions of start..end without a bar, and whether the range is complete."""
    days = calendar.where(F.col("session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("session_date")
    want = days.agg(F.count(F.lit(1)).alias("_n"))
    have = cached.join(F.broadcast(days), "session_date").groupBy("symbol").agg(F.count_distinct("session_date").alias("rows"))
    return have.crossJoin(F.broadcast(want)).select("symbol", "rows", (F.col("_n") - F.col("rows")).alias("gaps"), (F.col("_n") == F.col("rows")).alias("range_complete"))


def universe_csv(spark: SparkSession, path: str, least: int = 150) -> DataFrame:
    """symbol, company and sector of a constituents file, its columns found by name; fewer rows than `least` are an error."""
    raw = spark.read.option("header", True).csv(path)
    find = lambda part: next((c for c in raw.columns if part in c.lower()), None)
    names = {"symbol": find("symbol"), "company": find("company"), "sector": find("industry")}
    if not names["symbol"]:
        raise DataUnavailable("no symbol column")
    out = raw.select(*[(F.trim(F.col(f"`{c}`")) if c else F.lit(None).cast("string")).alias(k) for k, c in names.items()])
    if (n := out.count()) < least:
        raise DataUnavailable(f"{n} constituents; at least {least} are expected")
    return out


def universe_mode(point_in_time: bool) -> str:
    return "POINT_IN_TIME" if point_in_time else "CURRENT_CONSTITUENTS_SIMULATION"


def constituents_as_of(membership: DataFrame, date: str) -> DataFrame:
    """Members (symbol, valid_from, valid_to inclusive or null) on a date."""
    d = F.lit(date).cast("date")
    return membership.where((F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (F.col("valid_to") >= d))).select("symbol").distinct()


def latest_only(rows: DataFrame) -> DataFrame:
    """Rows that repeat (symbol, session_date): the last to arrive stays."""
    w = Window.partitionBy("symbol", "session_date").orderBy(F.desc("ingest_ts"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
