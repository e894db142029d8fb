"""Best-fit packing of tokenised documents into sequences, after a Martello-Toth dominance reduction.

Pieces of equal length are interchangeable, so the instance is the histogram of lengths: at most `capacity` counts,
whatever the corpus holds. The plan is made on these counts (the only thing that reaches the driver): first the
reduction fixes sets of one to three lengths that dominate every other way to fill a sequence with the largest length
left; a length with no such set is left to best-fit decreasing, and the reduction goes on with the next one. The plan is
a list of patterns (lengths in one sequence) with multiplicities, at most a few thousand; tasks rank the pieces of each
length, salted over buckets, and look their place up in it. A piece as long as a sequence needs no plan.

Null text counts as empty: a document of the end id alone. Texts are tokenised whole; what the pre-tokeniser parts is
encoded apart (see units()), which is exact because merges never cross it, and a bounded memo keeps frequent units. Rows
that repeat an id are separate documents only as far as (id, piece) tells them apart: each row gets a place of its own
all the same. A null id is packed like any other. An empty table gives an empty result. Of documents, columns other than
id and text are passed over; of pieces, they stay.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, stored, table, text_chunks, unused

DEFAULT_TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
#: A worker keeps the ids of the units it met last: between so many and twice as many units, or bytes of them.
MEMO_UNITS, MEMO_BYTES = 150_000, 16 << 20
#: Text bytes in one step of a task, whose arrays take some thirty times as much; smaller steps take more time.
CHUNK = 4 << 20
#: Rows of one length that a task ranks, about.
RANKED = 2_000

# Classes of bytes: white space, letters, digits, all else. C3 and a byte behind it are a Latin letter, but for C3 97 and C3 B7.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
_CLASS[48:58] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What may follow an apostrophe in the tokenizer's contractions ('s, 't, 're, 've, 'm, 'll, 'd); fixed values.
_CONTRACTION = np.zeros(256, bool)
_CONTRACTION[[ord(c) for c in "strvmldSTRVMLD"]] = True


def units(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """What the tokenizer encodes apart in the texts data[offs[i]:offs[i + 1]], in order, and the row of each unit.

    In words of ASCII and Latin letters these are runs of letters, single digits and runs of other characters, in lower
    case, as the tokenizer's own rule has them. A word with any other character, a possible contraction or a possible
    special token stays whole and as it is: the tokenizer parts it."""
    n = len(data)
    kind = _CLASS[data]
    before = np.zeros(n, np.uint8)
    before[1:] = data[:-1]
    heads = offs[:-1][offs[:-1] < n]
    before[heads] = 0
    second = before == 0xC3
    odd = (data >= 0x80) & (data != 0xC3) & ~second | second & ((data == 0x97) | (data == 0xB7)) | (data == 0x7C) & (before == 0x3C) | _CONTRACTION[data] & (before == 0x27)
    low = _LOWER[data]
    low[second & (data < 0x9F)] += 0x20
    text = kind != _SPACE
    starts = np.ones(n, bool)
    starts[1:] = kind[1:] != kind[:-1]
    starts[heads] = True
    starts |= kind == _DIGIT
    starts &= text
    if odd.any():
        word = text.copy()
        word[1:] &= ~text[:-1]
        word[heads] = text[heads]
        first = np.flatnonzero(word)
        k = np.unique(np.searchsorted(first, np.flatnonzero(odd), "right") - 1)
        a, b = first[k], np.append(first, n)[k + 1]
        edges = np.zeros(n + 1, np.int8)
        edges[a] = 1
        edges[b] -= 1
        whole = np.cumsum(edges[:n], dtype=np.int8) > 0
        starts &= ~whole
        starts[a] = True
        low = np.where(whole, data, low)
    at = np.flatnonzero(starts)
    packed = low[text]
    place = np.append(np.cumsum(text)[at] - 1, len(packed)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(place), pa.py_buffer(packed)])
    return found, np.searchsorted(offs, at, "right") - 1


class WordEncoder:
    """Token ids of texts: the units of a chunk are told apart by Arrow, and only those not met of late are encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.kept = 0

    def forget(self) -> None:
        self.new, self.old, self.kept = {}, {}, 0

    def _of(self, distinct: list[bytes]) -> list[bytes]:
        if len(self.new) > MEMO_UNITS or self.kept > MEMO_BYTES:
            self.old, self.new, self.kept = self.new, {}, 0
        new, old = self.new, self.old
        missing = [u for u in distinct if u not in new]
        unknown = []
        for u in missing:
            ids = old.get(u)
            if ids is None:
                unknown.append(u)
            else:
                new[u] = ids
        if unknown:
            encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
            for u, x in zip(unknown, encode([u.decode() for u in unknown], add_special_tokens=False)):
                new[u] = np.array(x.ids, "<u4").tobytes()
        self.kept += sum(map(len, missing))
        return list(map(new.__getitem__, distinct))

    def __call__(self, data: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one behind the other, each with `end` behind it, and where each text begins and ends."""
        found, row = units(data, offs)
        coded = found.dictionary_encode()
        told = [*self._of(coded.dictionary.to_pylist()), np.array([end], "<u4").tobytes()]
        flat = np.frombuffer(b"".join(told), "<u4")
        size = np.fromiter(map(len, told), np.int64, len(told)) // 4
        first = np.cumsum(size) - size
        n = len(offs) - 1
        # the end of each text is one more unit behind its last
        behind = np.searchsorted(row, np.arange(n), "right")
        which = np.insert(coded.indices.to_numpy().astype(np.int64), behind, len(told) - 1)
        each = size[which]
        ends = np.cumsum(each)
        ids = flat[np.repeat(first[which] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.append(0, ends[behind + np.arange(n)]) if n else np.zeros(1, np.int64)


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end: int = END, chunk: int = CHUNK) -> DataFrame:
    """id_col, piece, start, length, ids_crc32 and ids of each piece of at most `capacity` tokens."""

    def run(batches):
        from os import environ

        environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        enc = encoder(tokenizer)
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(1), chunk):
                rows: list[tuple] = []
                ids, cuts = enc(data, offs, end)
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()), lo):
                    for p, at in enumerate(range(a, b, capacity)):
                        x = ids[at : min(at + capacity, b)]
                        rows.append((i, p, at - a, len(x), zlib.crc32(x.data)))
                t = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t[:, 0])), pa.array(t[:, 1].astype(np.int32)), pa.array(t[:, 2]), pa.array(t[:, 3]), pa.array(t[:, 4])], names=[id_col, "piece", "start", "length", "ids_crc32"])
                release()
        enc.forget()
        release()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Patterns with multiplicities; `fixed` of them come from the reduction."""

    patterns: list[tuple[tuple[int, ...], int]]
    fixed: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    left = Counter({k: n for k, n in histogram.items() if n > 0})
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is outside 1..capacity")
    patterns: list[tuple[tuple[int, ...], int]] = []

    def fix(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        times = min(left[k] // n for k, n in need.items())
        patterns.append((tuple(sorted(lengths, reverse=True)), times))
        for k, n in need.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]

    for length in sorted(left, reverse=True):
        while length in left and (chosen := _dominating(left, length, capacity)):
            fix(chosen)
    fixed = len(patterns)
    return Plan(patterns + _best_fit(left, capacity), fixed)


def _dominating(left: Counter, length: int, capacity: int) -> tuple[int, ...] | None:
    """A set of up to three lengths with `length` that dominates every other set with it, or None.

    A set dominates another if the other's lengths can be parted among its own so that no part exceeds the length that
    takes it; then some best packing uses it. With the room beside `length`, these do: one length that fills the room;
    `length` alone if nothing fits; the longest that fits if no two others fit, or if no three fit and no two that fit
    are longer together; two that fill the room if no three fit, none is longer than the longer of them and no two that
    fit are both longer than the shorter."""
    room = capacity - length
    free = lambda k: left[k] - (k == length)
    if room and room in left and free(room):
        return length, room
    fits = sorted(k for k in left if k <= room and free(k))
    if not fits:
        return (length,)
    small = [k for k in fits[:3] for _ in range(min(3, free(k)))][:3]
    longest = fits[-1]
    if len(small) < 2 or sum(small[:2]) > room:
        return length, longest
    if len(small) == 3 and sum(small) <= room:
        return None
    best, at = 0, len(fits) - 1
    for k in fits:  # two pointers: the longest partner of each k
        while at >= 0 and fits[at] + k > room:
            at -= 1
        j = at if at >= 0 and (fits[at] != k or free(k) > 1) else at - 1
        if j >= 0:
            best = max(best, k + fits[j])
    if longest >= best:
        return length, longest
    short = room - longest
    if short in left and free(short) > (short == longest):
        above = [k for k in fits if k > short for _ in range(min(2, free(k)))][:2]
        if len(above) < 2 or sum(above) > room:
            return length, longest, short
    return None


def _best_fit(left: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: the longest pieces first, each into the fullest sequence that has room for it.

    Open sequences that look alike are one entry (pattern, how many) under their room, so the work follows the number
    of distinct lengths and rooms."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((pattern, n))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, many = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, pattern, many = capacity, (), n
            each = room // length
            used = min(many, n // each)
            take = each if used else n
            used = max(used, 1)
            if pattern and many > used:
                put(room, pattern, many - used)
            put(room - take * length, pattern + (length,) * take, used)
            n -= used * take
    return [(pattern, n) for group in by_room.values() for pattern, n in group]


def places(found: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, copies, first sequence, offset) by length and rank: where the pieces of a length go.

    Of the run's ranks, `copies` in turn share a sequence, one behind the other from offset on."""
    out, seen, base = [], Counter(), 0
    for pattern, times in found.patterns:
        offset = 0
        for length, copies in sorted(Counter(pattern).items(), reverse=True):
            out.append((length, seen[length], times * copies, copies, base, offset))
            seen[length] += times * copies
            offset += copies * length
        base += times
    return sorted(out)


def pack(rows: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """rows (with length) with sequence_id and offset; columns of these names give way. rows must give the same rows each time it is read.

    A piece as long as a sequence is one of its own. The other pieces of a length are parted over as many buckets as make
    about `ranked` rows each (a broadcast row for each length, fewer than `capacity`); running sums over the buckets' sizes, in Spark, turn ranks within buckets into ranks.
    """
    rows = rows.drop("sequence_id", "offset")
    names = rows.columns
    k, bucket, n, first, rank = unused(names, "k", "bucket", "n", "first", "rank")
    counts = stored(rows.where(F.col("length") < capacity).groupBy("length").agg(F.count(F.lit(1)).alias("n")))  # capacity rows at most
    seen = {r.length: r.n for r in counts.collect()}
    runs = np.array(places(plan(seen, capacity)), np.int64).reshape(-1, 6)
    # rows made on the driver would have Python workers of their own, with a daemon, beside those of the stages
    buckets = counts.select("length", F.ceil(F.col("n") / ranked).alias(k))
    # by all columns: rows without an id, or with one that repeats, differ in their tokens' checksums
    salted = rows.join(F.broadcast(buckets), "length").select(*names, F.pmod(F.xxhash64(*names), k).alias(bucket))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(n)).select("length", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = F.row_number().over(Window.partitionBy("length", bucket).orderBy(*names)) - 1
    placed = salted.withColumn(rank, within).join(starts, ["length", bucket]).select(*names, (F.col(rank) + F.col(first)).alias(rank))
    index = names.index("length")

    def run(batches):
        key = runs[:, 0] << 40 | runs[:, 1]
        for batch in batches:
            length, ranks = batch.column(index).to_numpy(zero_copy_only=False), batch.column(len(names)).to_numpy(zero_copy_only=False)
            r = runs[np.searchsorted(key, length << 40 | ranks, "right") - 1]
            at = ranks - r[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(r[:, 4] + at // r[:, 3]), pa.array(r[:, 5] + at % r[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*rows.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    alone = rows.where(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.mapInArrow(run, schema).unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    return pack(stored(pieces(docs, tokenizer or public_tokenizers.path(DEFAULT_TOKENIZER), capacity, chunk=chunk)), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
