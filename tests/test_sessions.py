"""Special sessions: what is accepted, what acts, what is known of times, and which session a scan is for."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sessions as ses

D, T = dt.date, dt.datetime
GOOD = {"session_date": D(2026, 11, 8), "is_trading_day": True, "session_type": "MUHURAT", "session_open": None, "session_close": None, "timing_verified": False, "source": "a list", "source_url": None, "verified_at": None, "official_document_verified": False, "calendar_version": "v1", "note": None}


def entries(spark, *changes):
    return spark.createDataFrame([tuple((GOOD | c).values()) for c in changes], ses.ENTRY)


def test_validation(spark):
    cases = [
        ({}, []), ({"session_open": "18:15", "session_close": "19:15"}, ["UNVERIFIED_TIME"]), ({"session_open": "18:15", "session_close": "19:15", "timing_verified": True}, []), ({"session_open": "18:15", "timing_verified": True}, ["TIME_MISSING"]),
        ({"is_trading_day": False}, ["CLOSED_BUT_NO_HOLIDAY"]), ({"is_trading_day": False, "session_type": "HOLIDAY"}, []), ({"session_type": "HOLIDAY"}, ["HOLIDAY_BUT_TRADING"]), ({"session_type": "PARTY", "source": " "}, ["UNKNOWN_TYPE", "NO_SOURCE"]),
        ({"session_date": None, "is_trading_day": None}, ["NO_DATE", "NO_TRADING_FLAG"]), ({"session_open": "25:00", "session_close": "9:15", "timing_verified": True}, ["NOT_A_CLOCK_TIME"]), ({"session_open": "19:15", "session_close": "18:15", "timing_verified": True}, ["CLOSES_BEFORE_OPENING"]),
        ({"timing_verified": None, "session_open": "10:00"}, ["UNVERIFIED_TIME"]),
    ]
    df = entries(spark, *[c | {"note": str(k)} for k, (c, _) in enumerate(cases)])
    got = {int(r.note): r.reasons for r in ses.validate(df).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_precedence(spark):
    df = entries(spark, {"note": "a"}, {"note": "b", "verified_at": D(2026, 1, 1)}, {"note": "c", "official_document_verified": True}, {"note": "d", "verified_at": D(2026, 5, 1), "calendar_version": "v2"}, {"note": "e", "official_document_verified": True, "session_open": "x"})
    assert [r.note for r in ses.acting(df).collect()] == ["c"]
    assert [r.note for r in ses.acting(df.where("note IN ('a', 'b', 'd')")).collect()] == ["d"]
    assert ses.acting(df.union(df)).count() == 1 and ses.acting(df.limit(0)).count() == 0


def test_read_entries(spark, tmp_path):
    assert ses.read_entries(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "s.json").write_text(json.dumps(GOOD | {"session_date": "2026-11-08"}) + "\n" + json.dumps({"session_date": "2026-12-25", "is_trading_day": False, "session_type": "HOLIDAY", "source": "x"}) + "\n")
    rows = ses.validate(ses.read_entries(spark, f"file://{tmp_path}/s.json")).collect()
    assert {r.session_date for r in rows} == {D(2026, 11, 8), D(2026, 12, 25)} and all(r.reasons == [] for r in rows)


@pytest.fixture(scope="module")
def table(spark):
    regular = spark.createDataFrame([(D(2026, 11, d),) for d in (2, 3, 4, 5, 6, 9, 10, 10)] + [(None,)], "session_date date")
    facts = entries(spark, {}, {"session_date": D(2026, 11, 4), "is_trading_day": False, "session_type": "HOLIDAY"}, {"session_date": D(2026, 11, 7), "session_type": "SPECIAL", "session_open": "18:15", "session_close": "19:15", "timing_verified": True}, {"session_date": D(2026, 11, 11), "session_open": "10:00"})
    return ses.session_table(regular, facts)


def test_session_info(spark, table):
    asked = spark.createDataFrame([(D(2026, 11, d),) for d in (3, 4, 7, 8, 8, 11, 12)], "date date")
    got = {r.session_date.day: r for r in ses.session_info(asked, table).collect()}
    assert {d: (r.is_trading_day, r.has_verified_timing, r.is_special) for d, r in got.items()} == {3: (True, True, False), 4: (False, False, False), 7: (True, True, True), 8: (True, False, True), 11: (False, False, False), 12: (False, False, False)}
    assert got[3].session_open == T(2026, 11, 3, 3, 45) and got[3].session_close == T(2026, 11, 3, 10, 0) and got[7].session_close == T(2026, 11, 7, 13, 45)
    assert got[8].session_open is None and got[8].note == "MUHURAT; timing_verified=false; source=a list" and got[4].session_open is None
    assert ses.session_table(spark.createDataFrame([], "session_date date")).count() == 0


def test_analysis_dates(spark, table):
    """Local times are five and a half hours ahead."""
    at = lambda d, h, m=0: T(2026, 11, d, h, m) - dt.timedelta(hours=5, minutes=30)
    cases = [
        (at(3, 15, 59), None, D(2026, 11, 2), None), (at(3, 16), None, D(2026, 11, 3), None), (at(4, 20), None, D(2026, 11, 3), None), (at(7, 18), None, D(2026, 11, 6), None), (at(7, 19, 15), None, D(2026, 11, 7), None),
        (at(8, 20), None, D(2026, 11, 7), None), (at(9, 0, 5), None, D(2026, 11, 8), None), (at(3, 12), D(2026, 11, 3), None, "NOT_ENDED"), (at(3, 17), D(2026, 11, 3), D(2026, 11, 3), None), (at(3, 17), D(2026, 11, 5), None, "FUTURE"),
        (at(5, 17), D(2026, 11, 4), None, "NO_SESSION"), (at(8, 19), D(2026, 11, 8), None, "UNVERIFIED_TIMING"), (at(9, 18), D(2026, 11, 8), D(2026, 11, 8), None), (at(1, 12), None, None, "NONE"), (at(10, 17), D(2026, 11, 2), D(2026, 11, 2), None), (T(2027, 2, 1), None, None, "NONE"),
    ]
    asks = spark.createDataFrame([(k, now, manual) for k, (now, manual, _, _) in enumerate(cases)] * 2, "k int, now timestamp, manual date")
    rows = ses.analysis_dates(asks, table).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        assert (r.analysis_date, r.error, r.mode) == (*cases[r.k][2:], "AUTOMATIC" if r.manual is None else "MANUAL"), r


def test_asks_are_not_multiplied_by_days(spark, table):
    """Asks meet a row for a day, once, without a shuffle; one without a time has a row too."""
    asks = spark.createDataFrame([(1, T(2026, 11, 3, 11), None), (2, None, None), (3, None, D(2026, 11, 3))], "k int, now timestamp, manual date")
    got = ses.analysis_dates(asks, table)
    assert {r.k: (r.analysis_date, r.mode, r.error) for r in got.collect()} == {1: (D(2026, 11, 3), "AUTOMATIC", None), 2: (None, "AUTOMATIC", "NONE"), 3: (None, "MANUAL", "NOT_ENDED")}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "manual" in x and ("Generate" in x or "Aggregate" in x)], plan
    assert [r.analysis_date for r in ses.analysis_dates(asks.where("k = 1"), table, cutoff="23:00", back=0).collect()] == [None]
