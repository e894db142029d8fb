"""Data quality of bars in one pass, and the audit of a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def quality_report(bars: DataFrame, calendar: DataFrame, analysis_date: str, max_stale: int = 5, jump: float = 0.30, sequence: str | None = None) -> DataFrame:
    """A row for each symbol: status PASS, WARN or FAIL, issues, counts, and whether it may give signals.

    Run it before NaN becomes null. sequence: a column with the order of arrival, for the check that dates ascend."""
    day = F.lit(analysis_date).cast("date")
    no = calendar.select("session_date", "session_no", F.col("next_session"))
    at = calendar.where(F.col("session_date") <= day).agg(F.max("session_no")).first()[0] or 0
    w = Window.partitionBy("symbol").orderBy("session_date")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    before = F.lag("close").over(w)
    rows = bars.withColumns({"_ret": F.abs(F.try_divide(F.col("close"), before) - 1), "_dup": F.col("session_date").eqNullSafe(F.lag("session_date").over(w))})
    if sequence:
        rows = rows.withColumn("_back", F.col("session_date") < F.lag("session_date").over(Window.partitionBy("symbol").orderBy(sequence)))
    else:
        rows = rows.withColumn("_back", F.lit(False))
    rows = rows.join(no.select("session_date", "session_no"), "session_date", "left")
    bad = F.lit(False)
    for c in (*PRICES, "volume"):
        x = F.col(c)
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    o, h, l, c = (F.col(x) for x in PRICES)
    report = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"),
        count(F.col("_dup")).alias("duplicate_dates"), count(F.col("_back")).alias("unordered"), count(bad).alias("non_finite"),
        count((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)).alias("non_positive"), count(h < l).alias("high_below_low"),
        count((h < o) | (h < c) | (l > o) | (l > c)).alias("outside_range"), count(F.col("_ret") > jump).alias("jumps"),
        F.max("session_no").alias("_last_no"), F.min("session_no").alias("_first_no"), F.count_distinct("session_no").alias("_held"), count(F.col("session_date") == day).alias("_today"),
    )
    report = report.withColumns({"stale_sessions": F.greatest(F.lit(0), F.lit(at) - F.coalesce("_last_no", F.lit(0)) ), "missing_sessions": F.coalesce(F.col("_last_no") - F.col("_first_no") + 1 - F.col("_held"), F.lit(0)), "has_analysis_date": F.col("_today") > 0})
    fails = {"duplicate_dates": "duplicate dates", "unordered": "dates not ascending", "non_finite": "null, NaN or infinite values", "non_positive": "prices not positive", "high_below_low": "high below low"}
    warns = {"outside_range": "open or close outside high and low", "jumps": "large daily moves", "missing_sessions": "missing sessions"}
    failed = F.array_compact(F.array(*[F.when(F.col(k) > 0, v) for k, v in fails.items()]))
    warned = F.array_compact(F.array(*[F.when(F.col(k) > 0, v) for k, v in warns.items()], F.when(F.col("stale_sessions") > max_stale, "stale"), F.when(~F.col("has_analysis_date"), "no bar on the analysis date")))
    report = report.withColumns({"issues": F.concat(failed, warned), "status": F.when(F.size(failed) > 0, "FAIL").when(F.size(warned) > 0, "WARN").otherwise("PASS")})
    return report.withColumn("eligible", (F.col("status") != "FAIL") & F.col("has_analysis_date")).drop("_last_no", "_first_no", "_held", "_today")


def contract(rows: DataFrame, date: str = "session_date") -> DataFrame:
    """What rows that ought to be bars break of their form: symbol, issue, rows (of that symbol; null for the whole table).

    Columns that are missing or not numbers, a date column that is none or a point in time of some zone, a time of day in
    it, rows without symbol or date, and a table without rows. Nothing is repaired. Empty if all is well."""
    kinds = dict(rows.dtypes)
    number = ("tinyint", "smallint", "int", "bigint", "float", "double")
    whole = [f"missing column {c}" for c in ("symbol", date, *PRICES, "volume") if c not in kinds]
    whole += [f"{c} is no number but {kinds[c]}" for c in (*PRICES, "volume") if c in kinds and not (kinds[c] in number or kinds[c].startswith("decimal"))]
    kind = kinds.get(date, "date")
    whole += [f"{date} is in a time zone"] if kind == "timestamp" else [f"{date} is no date but {kind}"] if kind not in ("date", "timestamp_ntz") else []
    out = rows.sparkSession.createDataFrame([(None, issue, None) for issue in whole], "symbol string, issue string, rows long")
    symbol = F.col("symbol").cast("string") if "symbol" in kinds else F.lit(None).cast("string")
    tests = {"rows without symbol": symbol.isNull()} if "symbol" in kinds else {}
    if date in kinds:
        tests["rows without date"] = F.col(date).isNull()
        if kind.startswith("timestamp"):
            tests["a time of day in the date"] = F.col(date) != F.date_trunc("day", date).cast(kind)
    if tests:
        counts = rows.groupBy(symbol.alias("symbol")).agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])
        out = out.unionByName(counts.unpivot("symbol", list(tests), "issue", "rows").where("rows > 0"))
    none = rows.agg(F.count(F.lit(1)).alias("rows")).where("rows = 0").select(F.lit(None).cast("string").alias("symbol"), F.lit("no rows").alias("issue"), F.lit(None).cast("long").alias("rows"))
    return out.unionByName(none)


def tally(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("symbols"))


def data_audit(requested: DataFrame, bars: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Each requested symbol with ELIGIBLE or EXCLUDED, its rows, coverage and missing sessions in a window."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    expected = calendar.where(F.col("session_date").between(a, b)).count()
    held = bars.where(F.col("session_date").between(a, b)).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"))
    out = requested.select("symbol").distinct().join(held, "symbol", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.withColumns({"status": F.when(F.col("rows") > 0, "ELIGIBLE").otherwise("EXCLUDED"), "reason": F.when(F.col("rows") == 0, "no bars in the window"), "missing": F.lit(expected) - F.col("rows"), "coverage_pct": F.try_divide(F.col("rows") * 100.0, F.lit(expected))})
