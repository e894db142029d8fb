"""Draws by halving against plain multinomial draws, and intervals against plain resampling."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import bootstrap

D = dt.date


@pytest.mark.parametrize("clusters", [1, 5, 63, 64, 65, 1000])
def test_draws(clusters):
    """Every replicate draws as many as there are; counts have the moments of multinomial ones, neighbours over leaves too."""
    n = 4000
    draws = bootstrap.Draws(7, n, clusters)
    leaves = range(-(-clusters // bootstrap.LEAF))
    counts = np.hstack([draws.of(k) for k in leaves])
    assert counts.shape == (n, clusters) and (counts.sum(1) == clusters).all() and counts.min() >= 0
    # in any order, and alone
    for k in [*leaves][::-1]:
        assert (bootstrap.Draws(7, n, clusters).of(k) == draws.of(k)).all()
    p = 1 / clusters
    assert abs(counts.mean(0) - 1).max() < 6 * np.sqrt(1 / n) and abs(counts.var(0) - (1 - p)).max() < 0.25
    if clusters > 1:
        a, b = counts[:, 0].astype(float), counts[:, -1].astype(float)
        assert abs(np.mean(a * b) - (1 - p)) < 0.15  # E[ab] of a multinomial: 1 - 1/K
    drawn = (counts > 0).mean()
    assert abs(drawn - (1 - (1 - p) ** clusters)) < 0.01


def plain(values, clusters, replicates, seed):
    """Means under resampling of clusters, drawn one by one."""
    rng, groups = np.random.default_rng(seed), {}
    for c, v in zip(clusters, values):
        groups.setdefault(c, []).append(v)
    s, n = np.array([sum(g) for g in groups.values()]), np.array([len(g) for g in groups.values()])
    draw = rng.integers(0, len(s), (replicates, len(s)))
    return s[draw].sum(1) / n[draw].sum(1)


@pytest.mark.parametrize("clusters", [4, 300])
def test_interval_in_distribution(spark, clusters):
    rng = np.random.default_rng(clusters)
    keys = rng.integers(0, clusters, 3000)
    effect = rng.normal(0, 3, clusters)
    values = effect[keys] + rng.normal(0, 1, len(keys))
    ev = spark.createDataFrame([(f"T{k}", float(v)) for k, v in zip(keys, values)] + [(None, 1e9), ("T0", None)], "symbol string, r double")
    got = bootstrap.cluster_bootstrap(ev, "r", "symbol").first()
    low, high = np.quantile(plain(values, keys, 20_000, 1), [0.025, 0.975])
    assert got.replicates == 2000 and got.n_clusters == len(set(keys)) and np.isclose(got.mean_return_pct, values.mean())
    assert abs(got.ci_low - low) < 0.08 * (high - low) and abs(got.ci_high - high) < 0.08 * (high - low)
    # however the rows are dealt
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    again = bootstrap.cluster_bootstrap(ev.repartition(5), "r", "symbol").first()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.isclose(again.ci_low, got.ci_low) and np.isclose(again.ci_high, got.ci_high)


def test_two_ways_over_many_tiles(spark):
    """More tickers and dates than a tile has, against the definition."""
    rng = np.random.default_rng(3)
    cells = {(t, d): float(rng.normal(t % 7, 2)) for t in range(150) for d in range(90) if rng.random() < 0.08}
    ev = spark.createDataFrame([(f"T{t:03}", D(2024, 1, 1) + dt.timedelta(d), v) for (t, d), v in cells.items()], "symbol string, execution_date date, r double")
    got = bootstrap.two_way_bootstrap(ev, "r").first()
    t, d, v = (np.array(x) for x in zip(*[(a, b, c) for (a, b), c in cells.items()]))
    means = []
    for _ in range(4000):
        a, b = np.zeros(150, bool), np.zeros(90, bool)
        a[rng.choice(np.unique(t), len(np.unique(t)))] = True
        b[rng.choice(np.unique(d), len(np.unique(d)))] = True
        means.append(v[a[t] & b[d]].mean())
    low, high = np.quantile(means, [0.025, 0.975])
    assert abs(got.both_low - low) < 0.1 * (high - low) and abs(got.both_high - high) < 0.1 * (high - low)
    assert got.ci_low == min(got.ticker_low, got.date_low, got.both_low) and got.replicates == 2000


def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], "symbol string, execution_date date, r double")
    assert bootstrap.cluster_bootstrap(none, "r", "symbol").first().asDict() == {"mean_return_pct": None, "n_clusters": 0, "ci_low": None, "ci_high": None, "replicates": 0}
    one = none.unionByName(spark.range(3).select(F.lit("A").alias("symbol"), F.lit(None).cast("date").alias("execution_date"), F.lit(1.0).alias("r")))
    assert bootstrap.cluster_bootstrap(one, "r", "symbol").first().ci_low == 1.0 and bootstrap.two_way_bootstrap(one, "r").first().replicates == 0
