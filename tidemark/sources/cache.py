"""A table of keyed rows that is brought up to date partition by partition.

Rows lie in partitions by month. An upsert reads and rewrites the months of its new rows alone (copy on write), into a
folder of its own; the months that it doesn't touch stay where they are. What is live is told by the last manifest: a
small file with the folder of each month. A manifest is written aside and renamed into place as the very last step, and
never over another one, so a reader sees an upsert whole or not at all, a crash leaves at most a folder that nothing
names, and of two writers at once the second gets an error. Old manifests, with the folders that they alone name, stay
for readers that began before, until `expire`.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, stored

SCHEMA_VERSION = 1
#: The partition of rows without a date.
UNDATED = "none"


class Conflict(RuntimeError):
    """Another writer was faster; read again, then upsert again."""


def merged(cached: DataFrame, new: DataFrame, keys=("symbol", "session_date"), order: str = "ingest_ts") -> DataFrame:
    """Cached and new rows with the latest of each key: what arrived later wins, whatever its date.

    Of rows that arrived at the same time new ones win, then the greatest; a null time is the earliest. Rows of one side
    that repeat a key become one too. Combines on the map side."""
    both = cached.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_side")]
    latest = F.max(F.struct(F.col(order), F.col("_side"), F.struct(*rest).alias("r")))
    return both.groupBy(*keys).agg(latest.alias("_m")).select(*keys, "_m.r.*")


class BarCache:
    """Raw bars, or any rows with a date, by key; see the module. The schema grows with what is upserted."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("symbol", "session_date"), date: str = "session_date", order: str = "ingest_ts"):
        self.spark, self.keys, self.date, self.order = spark, keys, date, order
        jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs_path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(path).getFileSystem(self.conf)
        self.path = str(self.fs.makeQualified(self.fs_path(path)).toString()).rstrip("/")

    def _names(self, folder: str) -> list[str]:
        at = self.fs_path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("manifests") if n[:1] == "v" and n[1:].isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict | None:
        """Of a version, by default the last one: schema_version, schema, and the folder of each month."""
        version = self.version() if version is None else version
        if not version:
            return None
        file = self.fs.open(self.fs_path(f"{self.path}/manifests/v{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def _commit(self, version: int, manifest: dict) -> None:
        jvm, base = self.spark._jvm, f"{self.path}/manifests"
        aside, place = self.fs_path(f"{base}/.{uuid.uuid4().hex}"), self.fs_path(f"{base}/v{version}")
        out = self.fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.conf)
        try:
            context.rename(aside, place, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(aside, False)
            if self.fs.exists(place):
                raise Conflict(f"version {version} was written meanwhile") from e
            raise

    def _rows(self, manifest: dict, months: set[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{folder}/month={m}" for m, folder in sorted(manifest["months"].items()) if months is None or m in months]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """None (a miss) if nothing was written or the schema's version differs."""
        manifest = self.manifest()
        return self._rows(manifest) if manifest and manifest["schema_version"] == SCHEMA_VERSION else None

    def upsert(self, new: DataFrame) -> DataFrame | None:
        """Merges new rows in; see merged. No new rows, no new version."""
        version, old = self.version(), self.manifest()
        if old and old["schema_version"] != SCHEMA_VERSION:
            old = None
        month = F.coalesce(F.date_format(self.date, "yyyy-MM"), F.lit(UNDATED))
        fresh = stored(new.withColumn("month", month))
        touched = {r.month for r in fresh.select("month").distinct().collect()}  # a calendar's months at most
        if touched:
            rows = fresh.drop("month")
            held = self._rows(old, touched) if old else rows.limit(0)
            out = merged(held, rows, self.keys, self.order)
            folder = f"{version + 1}-{uuid.uuid4().hex[:8]}"
            # ranges keep the number of files near that of months and tasks, and split a month that holds most rows
            placed = out.withColumn("month", month).repartitionByRange("month", *self.keys).sortWithinPartitions("month", *self.keys)
            placed.write.partitionBy("month").parquet(f"{self.path}/data/{folder}")
            self._commit(version + 1, {"schema_version": SCHEMA_VERSION, "schema": json.loads(out.schema.json()), "months": (old["months"] if old else {}) | dict.fromkeys(sorted(touched), folder)})
        discard(fresh)
        return self.read()

    def expire(self, keep: int = 2) -> int:
        """Deletes all versions but the last few and every file that no kept one names; returns how many folders went.

        Not to be called while an upsert runs: what it has written and not yet named would go too."""
        kept = self.versions()[-keep:]
        named = reduce(set.union, ({(folder, m) for m, folder in self.manifest(v)["months"].items()} for v in kept), set())
        gone = 0
        for name in self._names("manifests"):
            if name not in {f"v{v}" for v in kept}:
                self.fs.delete(self.fs_path(f"{self.path}/manifests/{name}"), False)
        for folder in self._names("data"):
            months = [n.removeprefix("month=") for n in self._names(f"data/{folder}") if n.startswith("month=")]
            live = [m for m in months if (folder, m) in named]
            for path in [f"data/{folder}"] if not live else [f"data/{folder}/month={m}" for m in months if m not in live]:
                self.fs.delete(self.fs_path(f"{self.path}/{path}"), True)
                gone += 1
        return gone
