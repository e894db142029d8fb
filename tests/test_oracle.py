"""Queries against their SQL, on the smallest tables."""

import datetime as dt

import pytest

from tidemark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: Fixed dates or rows in their SQL that the smallest tables don't have.
ELSEWHERE = {"swings_as_of", "valid_sessions", "split_adjusted", "quality_tally", "warmup_window", "analysis_date"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, dt.datetime):
        return v.date()
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(set(SQL) - ELSEWHERE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    cur = duck.execute(SQL[name])
    have = [c[0] for c in cur.description]
    assert sorted(have) == names
    want = [tuple(plain(r[have.index(c)]) for c in names) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert a == b or all(x == y or isinstance(x, float) and abs(x - y) <= 2e-5 for x, y in zip(a, b)), (a, b)
