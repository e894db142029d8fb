"""The cache's partitions and versions, the algebra of intervals, and refreshes with holes, corrections and outages."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources import repository as rep
from tidemark.sources.bars import RAW_SCHEMA, DataUnavailable
from tidemark.sources.cache import BarCache, Conflict
from tidemark.sources.calendar import calendar_table

D = dt.date
DAYS = [d.date() for d in pd.bdate_range("2024-01-01", "2024-06-28")]


@pytest.fixture(scope="module")
def calendar(spark):
    return calendar_table(spark.createDataFrame([(d,) for d in DAYS], "session_date date"))


def raw(spark, symbol, days, close=100.0, at="2024-07-01", source="seed"):
    stamp = dt.datetime.fromisoformat(at)
    return spark.createDataFrame([(symbol, d, close, close + 1, close - 1, close, 1000.0, close, 0.0, 0.0, source, stamp) for d in days], RAW_SCHEMA)


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_cache_rewrites_one_partition(spark, tmp_path):
    cache = BarCache(spark, f"file://{tmp_path}/c")
    cache.upsert(raw(spark, "A", DAYS).unionByName(raw(spark, "A", DAYS[:1], 7.0, "2024-07-02")).unionByName(raw(spark, "A", DAYS[:1], 5.0, "2024-06-02")))
    assert cache.read().count() == len(DAYS) and cache.read().where(F.col("session_date") == DAYS[0]).first().close == 7.0  # the first write, too
    before = files(tmp_path / "c" / "data")
    cache.upsert(raw(spark, "A", [D(2024, 3, 5)], 50.0, "2024-07-03"))
    new = files(tmp_path / "c" / "data") - before
    assert len(new) == 1 and "month=2024-03" in new.pop()
    assert cache.read().count() == len(DAYS) and cache.read().where("session_date = DATE '2024-03-05'").first().close == 50.0
    cache.upsert(raw(spark, "A", [D(2024, 3, 5)], 60.0, "2024-07-02"))  # arrived earlier: nothing changes
    assert cache.read().where("session_date = DATE '2024-03-05'").first().close == 50.0
    assert cache.upsert(raw(spark, "A", [])).count() == len(DAYS) and cache.version() == 3
    old = BarCache(spark, f"file://{tmp_path}/c")
    assert old._rows(old.manifest(1)).where("session_date = DATE '2024-03-05'").first().close == 100.0  # an older version can be read
    assert cache.expire(keep=1) > 0 and cache.versions() == [3] and cache.read().count() == len(DAYS)
    left = files(tmp_path / "c" / "data")
    assert len([f for f in left if "month=2024-03" in f]) == 1 and len({f.split("month=")[1][:7] for f in left}) == 6


def test_cache_survives_a_crash(spark, tmp_path, monkeypatch):
    cache = BarCache(spark, f"file://{tmp_path}/c")
    cache.upsert(raw(spark, "A", DAYS[:10]))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(cache, "_commit", dies)
        with pytest.raises(RuntimeError, match="lost"):
            cache.upsert(raw(spark, "A", DAYS[:20], 9.0, "2024-08-01"))
    assert cache.version() == 1 and cache.read().count() == 10 and {r.close for r in cache.read().collect()} == {100.0}
    # two writers began from the same version: the second one gets an error and changes nothing
    slow = BarCache(spark, f"file://{tmp_path}/c")
    monkeypatch.setattr(slow, "version", lambda: 0)
    cache2 = BarCache(spark, f"file://{tmp_path}/c")
    with pytest.raises(Conflict):
        slow._commit(1, cache2.manifest(1))
    cache.upsert(raw(spark, "A", DAYS[:20], 9.0, "2024-08-01"))
    assert cache.read().count() == 20
    cache.expire()
    assert {m for m in (tmp_path / "c" / "manifests").iterdir() if m.name.startswith("v")} and cache.read().count() == 20


def test_cache_takes_new_columns_and_undated_rows(spark, tmp_path):
    cache = BarCache(spark, f"file://{tmp_path}/c")
    cache.upsert(raw(spark, "A", DAYS[:3]))
    cache.upsert(raw(spark, "B", [None, None], 3.0).withColumn("note", F.lit("x")))
    rows = {(r.symbol, r.session_date): r.note for r in cache.read().collect()}
    assert rows == {("A", DAYS[0]): None, ("A", DAYS[1]): None, ("A", DAYS[2]): None, ("B", None): "x"}
    manifest = cache.manifest()
    assert set(manifest["months"]) == {"2024-01", "none"}


def intervals(df):
    return sorted((r.symbol, r.kind, r.from_date, r.to_date) for r in df.collect())


def brute(have, calendar, a, b, overlap=10):
    """The intervals of one symbol from its days (bars, answered), session by session."""
    bars, told = have
    days = [d for d in calendar if a <= d <= b]
    lack = [d not in bars and not any(x <= d <= y for x, y in told) for d in days]
    if lack and lack[-1] and not all(lack):
        held = [d for d in bars if d <= b]
        if held:
            least = max(held) - dt.timedelta(days=int(overlap * 1.5) + 3)
            k = next(i for i, d in enumerate(days) if d >= least or lack[i:] == [True] * (len(days) - i))
            lack[k:] = [True] * (len(days) - k)
    out, i = [], 0
    while i < len(days):
        j = i
        while j < len(days) and lack[j] == lack[i]:
            j += 1
        if lack[i]:
            out.append((days[i], days[j - 1]))
        i = j
    return out


def test_missing_intervals(spark, calendar):
    n = len(DAYS)
    cases = {
        "FULL": (set(DAYS), []), "NONE": (set(), []), "HEAD": (set(DAYS[20:]), []), "TAIL": (set(DAYS[:100]), []), "BOTH": (set(DAYS[20:100]), []), "HOLES": (set(DAYS) - set(DAYS[40:45]) - {DAYS[60]}, []),
        "TOLD": (set(DAYS[:50]), [(DAYS[48], DAYS[70]), (DAYS[60], DAYS[65]), (DAYS[90], DAYS[n - 1])]), "NEAR": (set(DAYS[:100]) - set(DAYS[95:97]) - set(DAYS[80:90]), []), "LOG": (set(), [(DAYS[0], DAYS[n - 1])]), "OUT": (set(DAYS[:5]), []),
    }
    held = spark.createDataFrame([(s, d) for s, (days, _) in cases.items() for d in days], "symbol string, session_date date")
    told = spark.createDataFrame([(s, a, b) for s, (_, x) in cases.items() for a, b in x], "symbol string, from_date date, to_date date")
    symbols = spark.createDataFrame([(s,) for s in cases] * 2, "symbol string")
    for a, b in ((DAYS[0], DAYS[-1]), (DAYS[10], DAYS[110]), (D(2024, 1, 6), D(2024, 1, 7)), (DAYS[50], DAYS[50]), (D(2023, 1, 1), D(2025, 1, 1))):
        got = intervals(rep.missing_intervals(symbols, held, told, calendar, str(a), str(b)))
        want = sorted((s, x, y) for s, have in cases.items() for x, y in brute(have, DAYS, a, b))
        assert [(s, x, y) for s, _, x, y in got] == want, (a, b)
    kinds = {s: {k for t, k, *_ in intervals(rep.missing_intervals(symbols, held, told, calendar, str(DAYS[0]), str(DAYS[-1]))) if t == s} for s in cases}
    assert kinds["NONE"] == {"WHOLE"} and kinds["BOTH"] == {"HEAD", "TAIL"} and kinds["HOLES"] == {"INSIDE"} and kinds["FULL"] == kinds["LOG"] == set()


def test_refresh(spark, calendar, tmp_path):
    """Cold, warm, longer at both ends, a hole that the source has and one that it hasn't, and corrections near the end."""
    everything = raw(spark, "A", [d for d in DAYS if d != DAYS[30]], 200.0).unionByName(raw(spark, "B", DAYS, 300.0))
    cache = BarCache(spark, f"file://{tmp_path}/c")
    cache.upsert(raw(spark, "A", [d for d in DAYS[20:100] if d not in (DAYS[30], DAYS[50], DAYS[51])]))
    repo = rep.Repository(cache, rep.from_table(everything, "vendor"), calendar)
    symbols = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    one = repo.refresh(symbols, str(DAYS[0]), str(DAYS[-1]))
    assert [x for x in intervals(one.fetched) if x[0] == "B"] == [("B", "WHOLE", DAYS[0], DAYS[-1])]
    of = {r.symbol: r for r in one.diagnostics.collect()}
    assert of["A"].status == "REFRESHED" and of["A"].rows_before == 77 and of["A"].rows_after == len(DAYS) - 1 and of["A"].internal_gap_sessions == [DAYS[30]] and of["A"].range_complete is False
    assert of["A"].previous_latest_session == DAYS[99] and of["A"].new_latest_session == DAYS[-1] and of["A"].resolved_source == "vendor"
    back = sum(d >= DAYS[99] - dt.timedelta(days=18) for d in DAYS[:100])
    assert of["A"].rows_downloaded == 20 + 2 + back + len(DAYS) - 100
    assert of["B"].status == "FILLED" and of["B"].range_complete is True and of["B"].rows_downloaded == len(DAYS)
    assert of["C"].status == "FILLED" and of["C"].rows_after == 0 and of["C"].range_complete is False
    closes = {r.session_date: r.close for r in one.bars.where("symbol = 'A'").collect()}
    assert closes[DAYS[60]] == 100.0 and closes[DAYS[99]] == closes[DAYS[50]] == closes[DAYS[0]] == 200.0  # the overlap takes corrections
    two = repo.refresh(symbols, str(DAYS[0]), str(DAYS[-1]))
    assert two.fetched.count() == 0 and {(r.status, r.rows_downloaded) for r in two.diagnostics.collect()} == {("HIT", 0)}
    inside = repo.refresh(symbols, str(DAYS[10]), str(DAYS[20]))
    assert inside.fetched.count() == 0 and inside.bars.count() == 22
    assert repo.refresh(symbols.limit(0), str(DAYS[0]), str(DAYS[-1])).diagnostics.count() == 0


def flaky(path):
    def call(symbol, a, b):
        if symbol == "DOWN":
            raise DataUnavailable("no such listing")
        if symbol == "ONCE":
            marks = path / f"{a}"
            if not marks.exists():
                marks.write_text("x")
                raise OSError("reset")
        days = [d for d in DAYS if a <= d <= b]
        return pd.DataFrame({"session_date": days, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 10.0})

    return call


def test_outages(spark, calendar, tmp_path):
    cache = BarCache(spark, f"file://{tmp_path}/c")
    cache.upsert(raw(spark, "DOWN", DAYS[:50]))
    first = rep.from_calls(flaky(tmp_path), "remote", tries=2, wait=0.01)
    repo = rep.Repository(cache, first, calendar)
    symbols = spark.createDataFrame([("DOWN",), ("ONCE",), ("UP",)], "symbol string")
    got = {r.symbol: r for r in repo.refresh(symbols, str(DAYS[0]), str(DAYS[-1])).diagnostics.collect()}
    assert got["DOWN"].status == "STALE" and got["DOWN"].error == "no such listing" and got["DOWN"].rows_after == 50
    assert got["ONCE"].status == got["UP"].status == "FILLED" and got["ONCE"].rows_after == len(DAYS)
    early = {r.symbol: r.status for r in repo.refresh(symbols, "2023-06-01", str(DAYS[-1])).diagnostics.collect()}
    assert early["DOWN"] == "STALE"  # no session lies before what is held
    # the failed interval is asked again, and the next provider in turn answers it
    backup = rep.from_table(raw(spark, "DOWN", DAYS, 5.0).unionByName(raw(spark, "UP", DAYS, 5.0)), "backup")
    repo.provider = rep.in_turn(first, backup)
    after = repo.refresh(symbols, str(DAYS[0]), str(DAYS[-1]))
    row = {r.symbol: r for r in after.diagnostics.collect()}
    assert row["DOWN"].status == "REFRESHED" and row["DOWN"].resolved_source == "backup" and row["DOWN"].range_complete and row["UP"].status == "HIT"
    gone = rep.Repository(BarCache(spark, f"file://{tmp_path}/d"), first, calendar).refresh(symbols, str(DAYS[0]), str(DAYS[9]))
    assert {r.symbol: r.status for r in gone.diagnostics.collect()} == {"DOWN": "UNAVAILABLE", "ONCE": "FILLED", "UP": "FILLED"}


def test_contract(spark):
    from tidemark.operators import checks

    good = "symbol string, session_date date, open double, high double, low double, close double, volume long"
    row = ("A", DAYS[0], 1.0, 2.0, 0.5, 1.5, 10)
    told = lambda df: {(r.symbol, r.issue, r.rows) for r in checks.contract(df).collect()}
    assert told(spark.createDataFrame([row], good)) == set()
    assert told(spark.createDataFrame([], good)) == {(None, "no rows", None)}
    assert told(spark.createDataFrame([row, (None, *row[1:]), ("A", None, *row[2:])], good)) == {(None, "rows without symbol", 1), ("A", "rows without date", 1)}
    at = lambda *t: [("A", dt.datetime(2024, 1, 2, *x), 1.0) for x in t]
    rest = {(None, f"missing column {c}", None) for c in ("high", "low", "close", "volume")}
    assert told(spark.createDataFrame(at((0,), (9, 15), (0, 0, 1)), "symbol string, session_date timestamp_ntz, open double")) == rest | {("A", "a time of day in the date", 2)}
    assert told(spark.createDataFrame(at((0,)), "symbol string, session_date timestamp, open double")) == rest | {(None, "session_date is in a time zone", None)}
    assert (None, "session_date is no date but string", None) in told(spark.createDataFrame([("A", "2024-01-02", "x")], "symbol string, session_date string, open string"))
