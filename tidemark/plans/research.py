"""Walk-forward evaluation and parameter sensitivity: folds and cells are keys of one plan, not loops of jobs."""

from __future__ import annotations

import datetime as dt
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.stats import performance
from ..operators.kernels import with_recursions
from ..sources.calendar import expected_week_ends, folds
from ..operators.joins import weekly_bars
from .events import event_study
from .features import assembled

GRID = {"fast": (8, 10, 12), "medium": (18, 20, 22), "structural": (80, 89, 100), "long": (180, 200, 220)}
CELL = "cell string, perturbed_param string, fast int, medium int, structural int, long int"


def evaluate_grid(spark, grid: dict[str, tuple]) -> DataFrame:
    """Every combination of a grid as a row."""
    names = list(grid)
    return spark.createDataFrame([tuple(c) for c in product(*grid.values())], names)


def cells(cfg: Config = Config(), grid: dict[str, tuple] | None = None) -> list[tuple]:
    """Cells that change one period of the base each; the base appears once for each parameter."""
    e = cfg.ema
    base = {"fast": e.fast, "medium": e.medium, "structural": e.structural, "long": e.long}
    return [(f"{p}={v}", p, *(base | {p: v}).values()) for p, values in (grid or GRID).items() for v in values]


def one_at_a_time(spark, cfg: Config = Config(), grid: dict[str, tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(cells(cfg, grid), CELL)


def cell_features(bars: DataFrame, index_bars: DataFrame, calendar: DataFrame, cells: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Features of every (cell, symbol): the recursions run once for each distinct period, then cells pick theirs."""
    periods = sorted({v for r in cells.select("fast", "medium", "structural", "long").distinct().collect() for v in r})  # a driver-made grid
    emas = {f"p{n}": n for n in periods}
    atr = f"ATR{cfg.volatility.atr_period}"
    d = with_recursions(bars.select("symbol", "session_date", "open", "high", "low", "close", "volume"), emas, cfg.ema.seed_method, (atr, cfg.volatility.atr_period))
    weekly = weekly_bars(bars, expected_week_ends(calendar)).withColumn("session_date", F.col("week_end"))
    w = with_recursions(weekly, emas, cfg.ema.seed_method)
    small = F.broadcast(cells.select("cell", "fast", "medium", "structural", "long"))  # as many rows as the grid has cells
    by_period = lambda role: F.element_at(F.create_map(*[x for n in periods for x in (F.lit(n), F.col(f"p{n}"))]), F.col(role))
    roles = {"EMA10": "fast", "EMA20": "medium", "EMA89": "structural", "EMA200": "long"}
    pick = lambda df, suffix: df.crossJoin(small).withColumns({f"{e}{suffix}": by_period(r) for e, r in roles.items()}).drop(*emas, *roles.values())
    return assembled(pick(d, ""), pick(w, "_W"), index_bars, calendar, cfg, ("cell", "symbol"), bars)


def ema_sensitivity(bars: DataFrame, index_bars: DataFrame, calendar: DataFrame, cfg: Config = Config(), grid: dict | None = None, horizon: int = 20) -> DataFrame:
    """n_trades and avg_return_pct of each cell; one without trades has none."""
    table = one_at_a_time(bars.sparkSession, cfg, grid)
    events = event_study(cell_features(bars, index_bars, calendar, table, cfg), calendar, cfg, keys=("cell", "symbol"))
    r = F.col(f"fwd_ret_{horizon}d")
    got = events.groupBy("cell").agg(F.count(r).alias("n_trades"), F.avg(r).alias("avg_return_pct"))
    return table.join(got, "cell", "left").withColumn("n_trades", F.coalesce("n_trades", F.lit(0)))


def plateau(table: DataFrame, metric: str = "avg_return_pct", label: str = "cell") -> DataFrame:
    """How flat a grid is: moments of the metric, its spread and the best cell."""
    m = F.col(metric)
    return table.agg(F.avg(m).alias("mean"), F.median(m).alias("median"), F.stddev_samp(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max"), (F.max(m) - F.min(m)).alias("spread"), F.max_by(label, F.when(m.isNotNull(), F.struct(m, F.col(label)))).alias("best"))


def fold_table(spark, first: dt.date, last: dt.date, cfg: Config = Config()) -> DataFrame:
    w = cfg.walk_forward
    return spark.createDataFrame(folds(first, last, w.train_years, w.test_years, w.step_years), "fold int, train_start date, train_end date, test_start date, test_end date")


def walk_forward_fixed(features: DataFrame, calendar: DataFrame, fold_rows: DataFrame, cfg: Config = Config(), horizon: int = 20, least_rows: int = 30) -> DataFrame:
    """Mode 1: the models as they are, evaluated inside each test window; what lies beyond its end is unknown there."""
    tests = F.broadcast(fold_rows.select("fold", "test_start", "test_end"))  # a row for each fold
    inside = features.join(tests, (F.col("session_date") >= F.col("test_start")) & (F.col("session_date") < F.col("test_end")))
    rows = F.count(F.lit(1)).over(Window.partitionBy("fold", "symbol"))
    events = event_study(inside.withColumn("_rows", rows).where(F.col("_rows") > least_rows).drop("_rows"), calendar, cfg, keys=("fold", "symbol"))
    stats = events.groupBy("fold", "entry_model").agg(*performance(F.col(f"fwd_ret_{horizon}d")))
    return stats.join(tests, "fold").withColumn("mode", F.lit("FIXED_SPEC"))


def walk_forward_selected(bars: DataFrame, index_bars: DataFrame, calendar: DataFrame, fold_rows: DataFrame, combos: list[tuple[int, int, int, int]], cfg: Config = Config(), horizon: int = 20, least_train: int = 30, least_test: int = 5) -> DataFrame:
    """Mode 2: on each fold's training window pick the combination with the best median return, then freeze it for the test.

    Averages use all bars before a window (warm-up); events and their horizons stay inside it. Of equal medians the first
    combination wins."""
    spark = bars.sparkSession
    cells = spark.createDataFrame([(str(i), "combo", *c) for i, c in enumerate(combos)], CELL)
    every = cell_features(bars, index_bars, calendar, cells, cfg)
    r = f"fwd_ret_{horizon}d"

    def within(a: str, b: str) -> DataFrame:
        windows = F.broadcast(fold_rows.select("fold", F.col(a).alias("_a"), F.col(b).alias("_b")))  # a row for each fold
        cut = every.join(windows, (F.col("session_date") >= F.col("_a")) & (F.col("session_date") < F.col("_b"))).drop("_a", "_b")
        return event_study(cut, calendar, cfg, keys=("fold", "cell", "symbol"))

    trained = within("train_start", "train_end").groupBy("fold", "cell").agg(F.median(r).alias("training_window_selection_metric"), F.count(r).alias("_n")).where(F.col("_n") > least_train)
    best = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("training_window_selection_metric"), F.col("cell").cast("int")))
    chosen = trained.withColumn("_best", best).where("_best = 1").drop("_best", "_n")
    tested = within("test_start", "test_end").join(chosen, ["fold", "cell"])
    stats = tested.groupBy("fold", "cell", "entry_model").agg(*performance(F.col(r)), F.first("training_window_selection_metric").alias("training_window_selection_metric")).where(F.col("n_trades") > least_test)
    named = cells.select("cell", *[F.col(c).alias(f"selected_training_{c}") for c in ("fast", "medium", "structural", "long")])
    return stats.join(F.broadcast(named), "cell").join(F.broadcast(fold_rows.select("fold", "test_start", "test_end")), "fold").drop("cell").withColumns({"mode": F.lit("TRAINED"), "selection_basis": F.lit(f"median {r}")})
