"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset: on one machine, below a folder of our own; on a cluster, an error."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_tidemark_shared", None)
        if base is None:
            base = spark._tidemark_shared = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}")
    return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows, stored, with `index`: their place by `order` from 0. They are sorted in ranges, and a table with a row for each range says how many rows lie before."""
    low = (1 << 33) - 1  # an id is the partition's number, then the row's place in it
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).select("*", F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(low).alias("_row")).drop("_id"))
    ranges = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return placed.join(ranges.select("_range", before.alias("_before")), "_range").withColumn("index", F.col("_before") + F.col("_row")).drop("_range", "_row", "_before")


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote for these tables. Nothing that is still to be computed may read them."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._tidemark_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
