"""The scan over blocks against the plain recursions, series by series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels

PERIODS = {"E1": 1, "E2": 2, "E10": 10, "E89": 89, "E200": 200}


def same(got, want):
    assert np.allclose(want, np.asarray(got, float), rtol=1e-10, atol=1e-9, equal_nan=True)


@pytest.fixture(scope="module")
def series(spark):
    """Long, short and holed series, one that begins with nulls, one of a bar a year, and NaN among the values."""
    rng, rows = np.random.default_rng(1), []
    for symbol, n, holes, step in (("A", 900, 0, "B"), ("B", 300, 0.1, "B"), ("C", 150, 0, "B"), ("D", 5, 0, "B"), ("E", 700, 0.5, "B"), ("F", 400, 0.003, "B"), ("G", 250, 0, "YE"), (None, 30, 0, "B")):
        days = pd.date_range("1990-03-01", periods=n, freq=step)
        close = 100 + rng.normal(0, 1, n).cumsum()
        columns = [close + rng.random(n), close - rng.random(n), close]
        for x in columns:
            x[rng.random(n) < holes] = np.nan
        if symbol == "F":
            close[:7] = np.nan
        nothing = None if symbol != "E" else float("nan")
        rows += [(symbol, d.date(), *[nothing if v != v else float(v) for v in r]) for d, *r in zip(days, *columns)]
    return spark.createDataFrame(rows, "symbol string, session_date date, high double, low double, close double").repartition(7)


@pytest.mark.parametrize("seed", ["sma", "first_obs"])
def test_scan_equals_the_loops(series, seed):
    got = kernels.with_recursions(series, PERIODS, seed, ("ATR", 14)).toPandas().sort_values("session_date")
    assert len(got) == series.count()
    for _, g in got.groupby("symbol", dropna=False):
        for name, period in PERIODS.items():
            same(g[name], kernels.ema(g["close"].to_numpy(float), period, seed))
        same(g["ATR"], kernels.wilder(kernels.true_range(*(g[c].to_numpy(float) for c in ("high", "low", "close"))), 14))


def test_one_long_history(spark):
    """A million bars of one symbol: many blocks, of which no task has more than a few."""
    n = 1_000_000
    bars = spark.range(n, numPartitions=8).select(F.lit("X").alias("symbol"), F.date_add(F.lit("0001-01-03").cast("date"), F.col("id").cast("int")).alias("session_date"), (100 + 20 * F.sin(F.col("id") / 50) + F.rand(3)).alias("close"))
    bars = bars.withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1})
    got = kernels.with_recursions(bars, {"E10": 10, "E200": 200}, "sma", ("ATR", 14)).orderBy("session_date").select("close", "high", "low", "E10", "E200", "ATR").toArrow()
    column = lambda c: got[c].to_numpy()
    assert got.num_rows == n
    same(column("E10"), kernels.ema(column("close"), 10))
    same(column("E200"), kernels.ema(column("close"), 200))
    same(column("ATR"), kernels.wilder(kernels.true_range(column("high"), column("low"), column("close")), 14))


def test_edges(spark):
    schema = "symbol string, session_date date, close double, E2 string, `odd name` int"
    empty = kernels.with_recursions(spark.createDataFrame([], schema), {"E2": 2})
    assert empty.count() == 0 and empty.columns == ["symbol", "session_date", "close", "odd name", "E2"]
    row = kernels.with_recursions(spark.createDataFrame([("A", None, 3.0, "x", 7)], schema), {"E2": 1, "none": 5}).first()
    assert row["odd name"] == 7 and row.E2 == 3.0 and row.none is None
    for wrong in ({"emas": {"a": 0}}, {"emas": {"a": 3}, "seed_method": "mean"}):
        with pytest.raises(ValueError):
            kernels.with_recursions(spark.createDataFrame([], schema), **wrong)
    two = spark.createDataFrame([("A", "x", i, float(i)) for i in range(5)], "symbol string, cell string, k int, close double").withColumn("session_date", F.date_add(F.lit("2024-12-29").cast("date"), "k"))
    assert [r.a for r in kernels.with_recursions(two, {"a": 2}, keys=("cell", "symbol")).orderBy("k").collect()][:3] == [None, 0.5, pytest.approx(1.5)]
