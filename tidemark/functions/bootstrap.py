"""Cluster bootstraps: intervals of a mean under resampling of whole clusters, by one key or by two.

A replicate draws as many clusters as there are, with replacement; what counts is how often each is drawn, a multinomial
vector. It is never drawn whole. Clusters are numbered, and the draws of a range of numbers part binomially between its
halves, so the counts of any LEAF numbers follow from one path through a binary tree whose nodes have generators of their
own, told by seed and range. A task so finds the counts of its own clusters, exactly, without those of others, for all
replicates at once: nothing is collected or broadcast, and results don't depend on how clusters lie in partitions. A task
holds LEAF counts for each replicate and its sums; sums add up over tasks in a fixed order.

Rows without value or cluster are left out. Without any, bounds are null and there are no replicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import numbered, stored

LEAF = 64
#: Cells whose weights are multiplied in one step.
STRIP = 1024


class Draws:
    """How often each of `clusters` clusters is drawn, for all replicates, LEAF clusters at a time."""

    def __init__(self, seed: int, replicates: int, clusters: int):
        self.seed, self.clusters = seed, clusters
        self.path = [(0, -(-clusters // LEAF), np.full(replicates, clusters))]
        self.last: tuple[int, np.ndarray] | None = None

    def _width(self, lo: int, hi: int) -> int:
        return min(hi * LEAF, self.clusters) - lo * LEAF

    def of(self, leaf: int) -> np.ndarray:
        """Replicates by clusters of a leaf. Leaves in order share the upper part of their paths."""
        if self.last and self.last[0] == leaf:
            return self.last[1]
        while not self.path[-1][0] <= leaf < self.path[-1][1]:
            self.path.pop()
        lo, hi, n = self.path[-1]
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = np.random.default_rng([self.seed, 0, lo, hi]).binomial(n, self._width(lo, mid) / self._width(lo, hi))
            lo, hi, n = (lo, mid, left) if leaf < mid else (mid, hi, n - left)
            self.path.append((lo, hi, n))
        width = self._width(lo, hi)
        self.last = leaf, np.random.default_rng([self.seed, 1, leaf]).multinomial(n, np.full(width, 1 / width))
        return self.last[1]


def _totals(parts: DataFrame, columns: list[str]) -> DataFrame:
    """The tasks' sums for each replicate, added up in the order of `part`; as many rows for a replicate as tasks."""
    ordered = F.sort_array(F.collect_list(F.struct("part", *columns)))
    of = parts.groupBy("replicate").agg(ordered.alias("all"))
    return of.select("replicate", *[F.aggregate(F.col(f"all.{c}"), F.lit(0.0), lambda a, x: a + x).alias(c) for c in columns])


def _interval(means: DataFrame, level: float) -> DataFrame:
    half = (1 - level) / 2
    return means.agg(F.percentile("mean", F.lit(half)).alias("ci_low"), F.percentile("mean", F.lit(1 - half)).alias("ci_high"), F.count("mean").alias("replicates"))


def cluster_bootstrap(events: DataFrame, column: str, cluster: str, replicates: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """mean_return_pct, n_clusters, ci_low, ci_high and replicates: the percentile interval of the mean of `column`."""
    rows = events.where(F.col(column).isNotNull() & F.col(cluster).isNotNull())
    sums = numbered(rows.groupBy(cluster).agg(F.sum(column).cast("double").alias("s"), F.count(column).alias("n")), cluster).select("index", "s", "n")
    clusters = sums.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draws, total, part = Draws(seed, replicates, clusters), np.zeros((replicates, 2)), None
        for frame in batches:
            for leaf, g in frame.sort_values("index").groupby(frame["index"] // LEAF):
                part = int(g["index"].iat[0]) if part is None else part
                total += draws.of(leaf)[:, g["index"] % LEAF] @ g[["s", "n"]].to_numpy(float)
        if part is not None:
            yield pd.DataFrame(total, columns=["s", "n"]).assign(replicate=np.arange(replicates), part=part)

    means = _totals(sums.mapInPandas(run, "s double, n double, replicate long, part long"), ["s", "n"]).select(F.try_divide("s", "n").alias("mean"))
    point = rows.agg(F.avg(column).alias("mean_return_pct"), F.count_distinct(cluster).alias("n_clusters"))
    return point.crossJoin(_interval(means, level))  # one row each


def two_way_bootstrap(events: DataFrame, column: str, ticker: str = "symbol", date: str = "execution_date", replicates: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """The widest bounds of resampling tickers, dates, and both at once (rows of drawn tickers on drawn dates).

    A row's weight in the last is whether its ticker and its date are drawn, so sums by (ticker, date) suffice; where no
    row has both, the rows of the drawn tickers count. Cells are dealt in tiles of LEAF tickers by LEAF dates, so that a
    task draws for few of either. replicates is the number of means behind the last interval. The events are stored
    first, as each part reads them again."""
    events = stored(events.select(ticker, date, column).dropna())
    a = cluster_bootstrap(events, column, ticker, replicates, seed, level)
    b = cluster_bootstrap(events, column, date, replicates, seed + 1, level)
    tickers = numbered(events.select(ticker).distinct(), ticker).withColumnRenamed("index", "t")
    dates = numbered(events.select(date).distinct(), date).withColumnRenamed("index", "d")
    many = tickers.count(), dates.count()
    cells = events.groupBy(ticker, date).agg(F.sum(column).cast("double").alias("s"), F.count(column).alias("n"))
    cells = cells.join(tickers, ticker).join(dates, date).select("t", "d", "s", "n", F.floor(F.col("t") / LEAF).alias("tile_t"), F.floor(F.col("d") / LEAF).alias("tile_d"))
    tiles = stored(cells.repartitionByRange("tile_t", "tile_d").sortWithinPartitions("tile_t", "tile_d", "t", "d"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_ticker, by_date, total, part = Draws(seed + 2, replicates, many[0]), Draws(seed + 3, replicates, many[1]), np.zeros((replicates, 4)), None
        for frame in batches:
            for (tile_t, tile_d), g in frame.groupby(["tile_t", "tile_d"]):
                part = int(g["t"].iat[0]) * many[1] + int(g["d"].iat[0]) if part is None else part
                some_t, some_d = by_ticker.of(tile_t) > 0, by_date.of(tile_d) > 0
                for k in range(0, len(g), STRIP):
                    x = g.iloc[k : k + STRIP]
                    one, values = some_t[:, x["t"] % LEAF], x[["s", "n"]].to_numpy(float)
                    total += np.hstack([(one & some_d[:, x["d"] % LEAF]) @ values, one @ values])
        if part is not None:
            yield pd.DataFrame(total, columns=["s", "n", "ticker_s", "ticker_n"]).assign(replicate=np.arange(replicates), part=part)

    sums = _totals(tiles.mapInPandas(run, "s double, n double, ticker_s double, ticker_n double, replicate long, part long"), ["s", "n", "ticker_s", "ticker_n"])
    means = sums.select(F.when(F.col("n") > 0, F.try_divide("s", "n")).otherwise(F.try_divide("ticker_s", "ticker_n")).alias("mean"))
    c = _interval(means, level).withColumnsRenamed({"ci_low": "c_low", "ci_high": "c_high"})
    both = a.drop("replicates").crossJoin(b.select(F.col("ci_low").alias("b_low"), F.col("ci_high").alias("b_high"))).crossJoin(c)  # one row each
    return both.select("mean_return_pct", F.least("ci_low", "b_low", "c_low").alias("ci_low"), F.greatest("ci_high", "b_high", "c_high").alias("ci_high"), F.col("ci_low").alias("ticker_low"), F.col("ci_high").alias("ticker_high"), F.col("b_low").alias("date_low"), F.col("b_high").alias("date_high"), F.col("c_low").alias("both_low"), F.col("c_high").alias("both_high"), "replicates")
