"""Files that scans and studies leave, and the manifest of a run."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import subprocess
import sys
import uuid
from importlib.metadata import PackageNotFoundError, version

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def is_percent(column: str) -> bool:
    """Whether a column is in percent, by its name."""
    return column.lower().endswith(("_pct", "_pct_10d")) or "_pct_" in column.lower() or column.startswith(("RS_", "fwd_ret_", "Fwd_Ret_"))


def percent_columns_as_fractions(df: DataFrame) -> DataFrame:
    """Columns in percent divided by 100, as a spreadsheet's percent format wants them."""
    return df.withColumns({c: F.col(c) / 100 for c, t in df.dtypes if t == "double" and is_percent(c)})


def content_hash(df: DataFrame) -> str:
    """A hash of the rows, whatever their order or partitioning; repeated rows count."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)], F.lit("|".join(sorted(df.columns))))
    r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")), F.bit_xor(row)).first()
    return hashlib.sha256(repr(tuple(map(str, r))).encode()).hexdigest()


def jsonable(x):
    if isinstance(x, dict):
        return {str(k): jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [jsonable(v) for v in x]
    if isinstance(x, float) and x != x:
        return None
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def git_state(folder: str = ".") -> dict:
    """Commit and whether there are changes; nulls where git can't tell."""
    ask = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, timeout=10)
    try:
        head, dirty = ask("rev-parse", "HEAD"), ask("status", "--porcelain")
        return {"commit": head.stdout.strip() or None, "dirty": bool(dirty.stdout.strip()) if head.returncode == 0 else None}
    except (OSError, subprocess.SubprocessError):
        return {"commit": None, "dirty": None}


def manifest(cfg, **facts) -> dict:
    def at(name: str):
        try:
            return version(name)
        except PackageNotFoundError:
            return None

    return jsonable({"run_id": uuid.uuid4().hex, "created_at": dt.datetime.now(dt.UTC).isoformat(), "config_hash": cfg.hash(), "python": sys.version.split()[0], "packages": {n: at(n) for n in ("pyspark", "pyarrow", "pandas", "numpy")}, **git_state(), **facts})


def write_manifest(spark: SparkSession, content: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_scan(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table by analysis date, as Parquet and CSV."""
    for name, df in tables.items():
        write_parquet(df, f"{folder}/{name}.parquet", ("Analysis_Date",))
        write_csv(df, f"{folder}/{name}.csv")
