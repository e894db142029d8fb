"""Recursions over a symbol's bars in order of date, as an associative scan over blocks.

A step of an exponential average is an affine map of its state, and maps compose: that of a block (a symbol's bars of one
year) is known without what came before. So blocks are made of bars in one shuffle, each folds itself into its map, the
few maps of a symbol are carried from block to block, and each block then runs its own bars from the state that it is
handed. A long history is as many tasks as it has years, all of it in expressions: no Python runs, and nothing loops but
the folds over a block's bars and over a symbol's blocks.

`ema`, `wilder` and `true_range` are the same rules for one series in NumPy, as plain versions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ema(values: np.ndarray, period: int, seed_method: str = "sma") -> np.ndarray:
    """Exponential average with alpha 2 / (period + 1).

    sma: null before `period` values, then the mean of the first `period` (nulls left out); first_obs: starts with the
    first value. A null value makes all later ones null."""
    if period <= 0:
        raise ValueError("period must be positive")
    if seed_method not in ("sma", "first_obs"):
        raise ValueError(f"unknown seed method {seed_method!r}")
    out = np.full(len(values), np.nan)
    start = period - 1 if seed_method == "sma" else 0
    if len(values) <= start or not len(values):
        return out
    head = values[: start + 1]
    head = head[~np.isnan(head)]
    now = sum(head.tolist()) / len(head) if len(head) else np.nan
    out[start] = now
    alpha = 2.0 / (period + 1)
    for i, x in enumerate(values[start + 1 :].tolist(), start + 1):
        now = (x - now) * alpha + now
        out[i] = now
    return out


def wilder(values: np.ndarray, period: int) -> np.ndarray:
    """Wilder's average: starts with the first value, null until `period` values; a null value leaves it as it is."""
    out = np.full(len(values), np.nan)
    now, seen, alpha = np.nan, 0, 1.0 / period
    for i, x in enumerate(values.tolist()):
        if x == x:
            now = x if seen == 0 else (1 - alpha) * now + alpha * x
            seen += 1
        if seen >= period:
            out[i] = now
    return out


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.append(np.nan, close[:-1]) if len(close) else close
    with np.errstate(invalid="ignore"):
        return np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))


class _Averages:
    """SQL for the steps of some averages. A state is a struct: bars so far, sum and count of values, an average each, and
    for the true range its average, the ranges so far and the last close."""

    NULL = "CAST(NULL AS DOUBLE)"

    def __init__(self, emas: dict[str, int], seed_method: str, atr: tuple[str, int] | None):
        if seed_method not in ("sma", "first_obs"):
            raise ValueError(f"unknown seed method {seed_method!r}")
        if any(p <= 0 for p in [*emas.values(), *([atr[1]] if atr else [])]):
            raise ValueError("period must be positive")
        self.alphas = [2.0 / (p + 1) for p in emas.values()]
        self.seeds = [p if seed_method == "sma" else 1 for p in emas.values()]
        self.atr = atr[1] if atr else None
        self.names = [*emas, *([atr[0]] if atr else [])]

    def state(self, g="0L", s="0D", c="0L", y=None, w=NULL, seen="0L", prev=NULL) -> str:
        averages = "".join(f", 'y{k}', {v}" for k, v in enumerate(y or [self.NULL] * len(self.seeds)))
        return f"named_struct('g', {g}, 's', {s}, 'c', {c}{averages}, 'w', {w}, 'seen', {seen}, 'prev', {prev})"

    @staticmethod
    def toward(now: str, x: str, alpha: float) -> str:
        return f"({x} - {now}) * {alpha!r}D + {now}"

    @staticmethod
    def ranged(prev: str, high: str, low: str) -> str:
        """True range; a missing part is left out."""
        return f"greatest({high} - {low}, abs({high} - {prev}), abs({low} - {prev}))"

    def smoothed(self, now: str, tr: str) -> str:
        a = 1.0 / self.atr
        return f"({1 - a!r}D * {now} + {a!r}D * {tr})"

    def bar(self, t: str, r: str) -> str:
        """The state behind one bar."""
        y = [f"CASE WHEN {t}.g + 1 < {n} THEN NULL WHEN {t}.g + 1 = {n} THEN try_divide({t}.s + coalesce({r}.x, 0D), {t}.c + int({r}.x IS NOT NULL)) ELSE {self.toward(f'{t}.y{k}', f'{r}.x', a)} END" for k, (n, a) in enumerate(zip(self.seeds, self.alphas))]
        so_far = (f"{t}.g + 1", f"{t}.s + coalesce({r}.x, 0D)", f"{t}.c + int({r}.x IS NOT NULL)", y)
        if self.atr is None:
            return self.state(*so_far)
        tr = self.ranged(f"{t}.prev", f"{r}.high", f"{r}.low")
        return self.state(*so_far, f"CASE WHEN {tr} IS NULL THEN {t}.w WHEN {t}.seen = 0 THEN {tr} ELSE {self.smoothed(f'{t}.w', tr)} END", f"{t}.seen + int({tr} IS NOT NULL)", f"{r}.close")

    def run(self, rows: str, state: str) -> str:
        """What each bar of a block shows, from the state before the block."""
        values = [f"x.y{k}" for k in range(len(self.seeds))] + ([f"CASE WHEN x.seen >= {self.atr} THEN x.w END"] if self.atr else [])
        shown = "named_struct(" + ", ".join(f"'v{k}', {v}" for k, v in enumerate(values)) + ")"
        none = "CAST(array() AS array<struct<" + ", ".join(f"v{k}: double" for k in range(len(values))) + ">>)"
        # the inner fold over one state names it, so that it is computed once
        return f"aggregate({rows}, named_struct('at', {state}, 'out', {none}), (acc, r) -> aggregate(array({self.bar('acc.at', 'r')}), acc, (o, x) -> named_struct('at', x, 'out', concat(o.out, array({shown})))), acc -> acc.out)"

    def summary(self, rows: str) -> dict[str, str]:
        """A block's maps: its bars, sums, what an average of zero becomes, and the same for true ranges behind its first bar."""
        out = {"n": f"bigint(size({rows}))", "s": f"aggregate({rows}, 0D, (a, r) -> a + coalesce(r.x, 0D))", "c": f"bigint(size(filter({rows}, r -> r.x IS NOT NULL)))", "xs": f"transform({rows}, r -> r.x)"}
        out |= {f"b{k}": f"aggregate({rows}, 0D, (a, r) -> {self.toward('a', 'r.x', alpha)})" for k, alpha in enumerate(self.alphas)}
        if self.atr is not None:
            tr = self.ranged("a.prev", "r.high", "r.low")
            step = f"named_struct('w', coalesce({self.smoothed('a.w', tr)}, a.w), 'm', a.m + int({tr} IS NOT NULL), 'first', coalesce(a.first, {tr}), 'prev', r.close)"
            rest = f"aggregate(slice({rows}, 2, size({rows})), named_struct('w', 0D, 'm', 0L, 'first', {self.NULL}, 'prev', {rows}[0].close), (a, r) -> {step})"
            out |= {"high": f"{rows}[0].high", "low": f"{rows}[0].low", "rest": rest}
        return out

    def block(self, t: str, b: str) -> str:
        """The state behind a block, from its maps; xs are needed where an average is seeded."""
        y = []
        for k, (n, a) in enumerate(zip(self.seeds, self.alphas)):
            at = f"greatest(0, int({n} - {t}.g))"  # the seed's place in the block, from 1
            head = f"filter(slice({b}.xs, 1, {at}), x -> x IS NOT NULL)"
            seed = f"try_divide({t}.s + aggregate({head}, 0D, (v, x) -> v + x), {t}.c + size({head}))"
            seeded = f"aggregate(slice({b}.xs, {at} + 1, size({b}.xs)), {seed}, (v, x) -> {self.toward('v', 'x', a)})"
            y.append(f"CASE WHEN {t}.g + {b}.n < {n} THEN NULL WHEN {t}.g >= {n} THEN {t}.y{k} * pow({1 - a!r}D, {b}.n) + {b}.b{k} ELSE {seeded} END")
        so_far = (f"{t}.g + {b}.n", f"{t}.s + {b}.s", f"{t}.c + {b}.c", y)
        if self.atr is None:
            return self.state(*so_far)
        # the first range of all starts the average: it counts as the state before itself
        tr = self.ranged(f"{t}.prev", f"{b}.high", f"{b}.low")
        start = f"coalesce({t}.w, {tr}, {b}.rest.first)"
        w = f"coalesce({self.smoothed(start, tr)}, {start}) * pow({1 - 1.0 / self.atr!r}D, {b}.rest.m) + {b}.rest.w"
        return self.state(*so_far, w, f"{t}.seen + int({tr} IS NOT NULL) + {b}.rest.m", f"{b}.rest.prev")

    def before(self, maps: str) -> str:
        """The state before each of a symbol's blocks, and behind the last."""
        return f"aggregate({maps}, array({self.state()}), (acc, b) -> concat(acc, array({self.block('element_at(acc, -1)', 'b')})))"


def with_recursions(bars: DataFrame, emas: dict[str, int], seed_method: str = "sma", atr: tuple[str, int] | None = None, keys: tuple[str, ...] = ("symbol",), value: str = "close") -> DataFrame:
    """bars with a column for each EMA and, if atr names one, the average true range.

    NaN counts as null. Bars that repeat a date stand in order of their values, bars without one first. bars is read
    twice: for the maps, and for the bars that run from the states."""
    of = _Averages(emas, seed_method, atr)
    given = bars.drop(*of.names)
    names = given.columns
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    parts = [F.col("session_date").alias("session_date"), number(value).alias("x"), *([number(c).alias(c) for c in ("high", "low", "close")] if atr else [])]
    block = F.coalesce(F.year("session_date"), F.lit(-1)).alias("__block")
    key = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    by = [f"__k{i}" for i in range(len(keys))]

    def blocks(*more: Column) -> DataFrame:
        rows = given.select(*key, block, F.struct(*parts, *more).alias("__r"))
        return rows.groupBy(*by, "__block").agg(F.sort_array(F.collect_list("__r")).alias("__rows"))

    maps = blocks().select(*by, "__block", *[F.expr(e).alias(k) for k, e in of.summary("__rows").items()])
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # values are needed only up to the last seed
    maps = maps.withColumn("xs", F.when(before < max([*of.seeds, 0]), F.col("xs")))
    chain = maps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__block", *[c for c in maps.columns if c not in (*by, "__block")]))).alias("maps"))
    states = chain.select(*by, F.expr("maps.__block").alias("__block"), F.expr(f"slice({of.before('maps')}, 1, size(maps))").alias("__state"))
    states = states.select(*by, F.inline(F.arrays_zip("__block", "__state")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "__block")]
    held = blocks(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).alias("r").join(states.alias("s"), same).select("r.__rows", "s.__state")
    shown = held.select(F.inline(F.arrays_zip(F.col("__rows.row").alias("row"), F.expr(of.run("__rows", "__state")).alias("shown"))))
    return shown.select("row.*", *[F.col(f"shown.v{k}").alias(name) for k, name in enumerate(of.names)])
