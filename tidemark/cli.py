"""python -m tidemark.cli COMMAND: scans and studies over a folder of tables or of bars."""

from __future__ import annotations

import argparse
import datetime as dt
import json
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as conf
from .operators import checks
from .operators.joins import cross_check
from .plans import backtest, events, research, scan
from .plans.features import features
from .sources import bars as src
from .sources import sinks
from .sources.calendar import calendar_table, required_warmup, resolve_analysis_date, warmup_start


def market(spark: SparkSession, folder: str, symbols: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, index bars, calendar) of a folder: its bars.parquet and index_bars.parquet, or bars of its trade tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bars.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        every, index = src.read(spark, f"{folder}/bars.parquet"), src.read(spark, f"{folder}/index_bars.parquet").drop("symbol")
    else:
        rows = src.trades(spark, folder)
        every, index = src.bars_from_trades(rows), src.bars_from_trades(rows, ())
    calendar = calendar_table(every.select("session_date"))
    chosen = every.where(F.col("symbol").isin(symbols.split(","))) if symbols else every
    return src.finite(chosen), src.finite(index), calendar


def frames(args, cfg, spark) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Features from the warm-up on, cut to start..end, with (bars, index, calendar)."""
    every, index, calendar = market(spark, args.data, args.symbols)
    start, end = (dt.date.fromisoformat(x) for x in (args.start, args.end))
    first = warmup_start(calendar, start, required_warmup(cfg.ema.long))
    near = every.where(F.col("session_date").between(F.lit(first), F.lit(end)))
    return features(near, index, calendar, cfg).where(F.col("session_date").between(F.lit(start), F.lit(end))), near, index, calendar


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *more: str):
        c = sub.add_parser(name)
        c.add_argument("--config")
        for m in ("data", "symbols", "output-dir", *more):
            c.add_argument(f"--{m}", required=m in ("start", "end"))
        return c

    command("show-config")
    command("scan", "date", "universe-limit")
    command("validate-data")
    command("cross-check-data", "other", "start", "end")
    command("event-study", "start", "end")
    b = command("backtest", "start", "end", "entry-model")
    b.add_argument("--exit-rule", choices=backtest.EXIT_RULES)
    command("walk-forward", "start", "end").add_argument("--mode", type=int, choices=(1, 2), default=1)
    command("sensitivity", "start", "end")
    args = p.parse_args(argv)
    cfg = conf.load_config(args.config)
    if args.command == "show-config":
        print(json.dumps(asdict(cfg) | {"hash": cfg.hash(), "warnings": conf.audit_config(cfg)}, indent=1, default=str))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    out = (args.output_dir or "out").rstrip("/")
    if args.command in ("scan", "validate-data"):
        every, index, calendar = market(spark, args.data, args.symbols)
        now = dt.datetime.now()
        sessions = calendar.select("session_date", F.lit("15:30").alias("close_time"))
        if args.command == "scan" and args.date:
            day = resolve_analysis_date(sessions, now, dt.date.fromisoformat(args.date)).date
        else:
            day = calendar.where(F.col("session_date") <= F.lit(now.date())).agg(F.max("session_date")).first()[0]
        report = checks.quality_report(every, calendar, str(day), cfg.max_stale_sessions)
        if args.command == "validate-data":
            sinks.write_parquet(report, f"{out}/quality.parquet")
            return 0
        if args.universe_limit:
            few = scan.first_symbols(every.select("symbol").distinct(), int(args.universe_limit))
            every = every.join(F.broadcast(few), "symbol")  # universe-limit rows
        rows = scan.scan_rows(features(every.where(F.col("session_date") <= F.lit(day)), index, calendar, cfg), calendar, str(day), cfg, report)
        sinks.write_scan(scan.scan_tables(rows), out)
        sinks.write_manifest(spark, sinks.manifest(cfg, analysis_date=str(day), command=args.command), f"{out}/manifest")
        return 0
    if args.command == "cross-check-data":
        inside = F.col("session_date").between(F.lit(args.start).cast("date"), F.lit(args.end).cast("date"))
        a, other = market(spark, args.data, args.symbols)[0], market(spark, args.other, args.symbols)[0]
        sinks.write_csv(cross_check(a.where(inside), other.where(inside), names=(args.data, args.other)), f"{out}/cross_check.csv")
        return 0
    feats, every, index, calendar = frames(args, cfg, spark)
    if args.command == "event-study":
        ev = events.event_study(feats, calendar, cfg)
        for name, df in {"event_study_raw": ev, "strategy_summary": events.comparison_table(ev), "regime_breakdown": events.regime_breakdown(ev), "concentration": events.concentration(ev), "overlap": events.signal_overlap(feats)}.items():
            sinks.write_csv(df, f"{out}/{name}.csv")
    elif args.command == "backtest":
        change = {k: v for k, v in (("exit_rule", args.exit_rule), ("entry_model_col", args.entry_model)) if v}
        result = backtest.run_backtests(feats, calendar, replace(cfg, backtest=replace(cfg.backtest, **change)))
        sinks.write_parquet(result, f"{out}/backtest.parquet")
        result = spark.read.parquet(f"{out}/backtest.parquet")
        for name, df in {"trade_log": backtest.trades(result), "portfolio_equity": backtest.equity(result), "skipped_signals": backtest.skipped(result)}.items():
            sinks.write_csv(df, f"{out}/{name}.csv")
    elif args.command == "walk-forward":
        table = research.fold_table(spark, dt.date.fromisoformat(args.start), dt.date.fromisoformat(args.end), cfg)
        e = cfg.ema
        df = research.walk_forward_fixed(feats, calendar, table, cfg) if args.mode == 1 else research.walk_forward_selected(every, index, calendar, table, [(e.fast, e.medium, e.structural, n) for n in (180, 200, 220)], cfg)
        sinks.write_csv(df, f"{out}/walk_forward.csv")
    else:
        sinks.write_csv(research.ema_sensitivity(every, index, calendar, cfg), f"{out}/sensitivity.csv")
    return 0


if __name__ == "__main__":
    raise SystemExit(run())
