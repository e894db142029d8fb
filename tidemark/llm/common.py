"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import discard, shared_dir, stored  # noqa: F401

#: Text bytes that one vectorised step handles; bounds the memory of a task.
CHUNK_BYTES = 1 << 18
#: A key with more than one row in HOT is hot.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until they are none of those taken, in whatever case."""
    taken_ = {t.lower() for t in taken}
    while any(n.lower() in taken_ for n in names):
        names = tuple(f"_{n}" for n in names)
    return list(names)


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined with groups, which has a row for each key with the number of its rows in `size`.

    Keys that hold more than a HOT-th of all rows, at most HOT of them, are broadcast; their rows are never shuffled. The
    others meet in a shuffle, where no key is hot. how: inner or left. groups is read several times."""
    least = F.lit((groups.agg(F.sum(size)).first()[0] or 0) / HOT)
    hot, cold = groups.where(F.col(size) > least), groups.where(F.col(size) <= least)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (lo, hi, bytes, offsets) for runs of rows of a string column with about `most` bytes; null counts as empty.

    A row longer than `most` comes alone. offsets has hi - lo + 1 entries that start at 0.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def appended(df: DataFrame, inputs: list[str], fields: list[T.StructField], compute: Callable[..., list[pa.Array]]) -> DataFrame:
    """df with the columns `fields`; a column of df by the same name gives way.

    compute gets runs of rows of the columns `inputs`, the last of which is a string column and decides where runs are
    cut (see text_chunks), and returns an array for each field."""
    new = {f.name.lower() for f in fields}
    kept = [i for i, f in enumerate(df.schema) if f.name.lower() not in new]
    read = [df.schema.names.index(c) for c in inputs]
    schema = T.StructType([*(df.schema[i] for i in kept), *fields])

    def run(batches):
        for batch in batches:
            for lo, hi, _, _ in text_chunks(batch.column(read[-1])):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *compute(*(part.column(i) for i in read))], names=schema.names)

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives what a task has freed back to the machine: a worker lives on, and its executor's next stages need the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
