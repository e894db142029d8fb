"""Exact Jaccard self-join of documents on five-word shingles, and the components of its links.

Method: a blocked sparse product of the document by shingle incidence that accumulates overlap counts and discards
pairs below bounds derived from set sizes.

1. Documents with equal sets become one class, represented by its smallest id; only representatives go on.
2. Two sets with Jaccard >= t and sizes n share one of the first n - ceil(t n) + 1 shingles of each (its prefix) in any
   order that all sets use. The order puts frequent shingles (told by a table of counts that grows with the corpus up to
   MOST_CELLS cells, so that the order is a function of the shingle) behind the others; it decides how fast the join is,
   not what it finds.
3. Prefix incidences are dealt by shingle. A shingle of up to ALL_PAIRS documents gives its pairs; counts of a pair add
   up over shingles, and a pair whose count, plus all that could follow behind the prefixes, can't reach the overlap
   that the sizes ask for is discarded. A shingle of more documents gives stars: pairs of a leader and each other one.
   Stars are held against the same bound, by the two prefixes.
4. Pairs left are verified on the whole sets. Links give components.
5. Shingles of more than ALL_PAIRS documents that lie in several components take further stars, with other leaders,
   then the product by blocks of documents. Shingles of much the same documents share a bundle, so that a document
   enters once for all of them; blocks are of one class of sizes, and meet only blocks of the same class or its
   neighbours. Each task multiplies two blocks of prefixes (dense where many documents share a shingle, by pairs elsewhere), skips pairs already in one component, discards by the same bound, then by counts of the whole
   sets in SKETCH cells (the overlap is at most the sum of the lesser counts), and hands on the rest to be verified. So
   no link between components is lost, and no group is expanded into all of its pairs.

Two documents link when 100 * |a & b| >= 80 * |a | b|. Words are runs of `[^\\x20\\x09-\\x0D]` with A-Z as a-z; fewer
than five words are one shingle. Null and empty texts have empty sets and link with nothing; a null id is left out of
links and stands for itself. Rows that repeat an id are one document, with the set of one of them. Shingles are 64-bit
hashes; ids are whole numbers. An empty table gives an empty result; other columns are passed over. Tables between steps are deleted once they are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_groups, list_array, mix, release, stored, table, text_chunks
from .words import shingle_sets

#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: Shingles of more documents give stars instead of all pairs.
ALL_PAIRS = 12
#: Cells of the table of counts: one for SHARE counted shingles, within these bounds. It is kept in SLICES.
SHARE, LEAST_CELLS, MOST_CELLS, SLICES = 8, 1 << 16, 1 << 27, 64
#: A shingle is frequent if its cell holds more than so many, and more than TIMES the mean.
FREQUENT, TIMES = 24, 4
#: Counted shingles that a task holds before it tells them, and that a group of such rows adds up.
HELD, ADDED = 1 << 21, 1 << 25
#: Bits of the filter that tells a scan which documents are wanted: eight for each document, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
BLOCK = 1024
STARS = 2
#: Cells of a document's sketch, and how many pairs have theirs compared in one step.
SKETCH, STRIP = 512, 8192


def prefix_size(n):
    return n - (NUM * n + DEN - 1) // DEN + 1


def _sets(docs: DataFrame, id_col: str, text_col: str, shape, fields: str, wanted: np.ndarray | None = None) -> DataFrame:
    """mapInArrow over documents: shape(ids, sets) gives the columns of `fields`.

    wanted: a filter of ids; documents outside it are passed over."""

    def run(batches):
        for batch in batches:
            if wanted is not None:
                batch = _wanted(batch, wanted)
            for lo, hi, data, offs in text_chunks(batch.column(1)):
                cols = shape(batch.column(0)[lo:hi], shingle_sets(data, offs))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
        release()

    return docs.select(id_col, text_col).mapInArrow(run, fields)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _wanted(batch: pa.RecordBatch, wanted: np.ndarray) -> pa.RecordBatch:
    """The rows whose id, the first column, the filter holds."""
    ids = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    k = _place(ids, len(wanted) * 64)
    return batch.filter(pa.array((wanted[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1) == 1))


def id_filter(ids: DataFrame) -> np.ndarray:
    """A filter that holds all ids, of MOST_BITS bits at most: what reaches the driver is bounded whatever their number.

    It may let other ids through, all of them where there are far more ids than bits; joins by id follow everywhere."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * ids.count()).bit_length()))

    def run(batches):
        held = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            k = _place(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits)
            np.bitwise_or.at(held, k >> 6, np.uint64(1) << (k & 63).astype(np.uint64))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(_signed(held[at]))], names=["w", "bits"])

    got = ids.select("id").mapInArrow(run, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got["w"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def _only(lists: DataFrame, wanted: np.ndarray) -> DataFrame:
    """The rows of lists (id first) whose id the filter holds, told before any shuffle."""

    def run(batches):
        for batch in batches:
            yield _wanted(batch, wanted)

    return lists.mapInArrow(run, lists.schema)


def _packed(cells: np.ndarray) -> bytes:
    """Ascending cells with repeats, as compressed differences."""
    return zlib.compress(np.diff(cells, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), "<u4"), dtype=np.int64)


def summaries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n and two sums that tell the set; and, with a null id, cells of the shingles in twice the prefixes by value.

    Of those rows, slice is the lowest bits of the cells, n how many, counts the other bits."""

    def run(batches):
        none = lambda k, kind: pa.nulls(k, kind)
        names = ["id", "n", "sig1", "sig2", "slice", "counts"]
        held: list[np.ndarray] = []

        def told():
            cells = np.concatenate([*held, np.zeros(0, np.uint32)])
            cells = np.sort((cells % SLICES) * np.uint32(MOST_CELLS // SLICES) + cells // SLICES)
            parts = np.split(cells, np.searchsorted(cells, np.arange(1, SLICES) * (MOST_CELLS // SLICES)))
            rows = [(k, len(x), _packed(x - np.uint32(k * (MOST_CELLS // SLICES)))) for k, x in enumerate(parts) if len(x)]
            held.clear()
            return pa.RecordBatch.from_arrays([none(len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *[none(len(rows), pa.int64())] * 2, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=names)

        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(1)):
                sets = shingle_sets(data, offs)
                wide = np.concatenate([*(s[: 2 * prefix_size(len(s)) + 4] for s in sets), np.zeros(0, np.uint64)])
                held.append((wide & np.uint64(MOST_CELLS - 1)).astype(np.uint32))
                k = hi - lo
                sigs = [pa.array([int(_signed(mix(s ^ np.uint64(x))).sum()) for s in sets], pa.int64()) for x in (0, 0x5851F42D4C957F2D)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *sigs, none(k, pa.int32()), none(k, pa.binary())], names=names)
                if sum(map(len, held)) > HELD:
                    yield told()
        if held:
            yield told()
        release()

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, "id long, n long, sig1 long, sig2 long, slice int, counts binary")


def frequent_cells(told: DataFrame) -> np.ndarray:
    """Bits that tell the cells of frequent shingles, slice by slice, in 64-bit words: at most MOST_CELLS bits.

    Rows of cells are added up in groups of about ADDED shingles, the tables of these in groups of 16 until there is one."""
    parts = told.where("slice IS NOT NULL").select("slice", "n", "counts")
    total = parts.agg(F.sum("n")).first()[0] or 0
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (total // SHARE).bit_length()))
    each = cells // SLICES
    most = max(FREQUENT, TIMES * total / cells)
    groups = max(1, total // SLICES // ADDED)

    def start(last):
        def run(key, t):
            n = np.zeros(each, np.int64)
            for x in t["counts"]:
                n += np.bincount(_unpacked(x.as_py()) & (each - 1), minlength=each)
            return out(key, n, last)

        return run

    def add(last):
        return lambda key, t: out(key, sum(np.frombuffer(zlib.decompress(x.as_py()), "<u4").astype(np.int64) for x in t["counts"]), last)

    def out(key, n, last):
        """The counts, or of the last tables the bits: by the same function, as a further step would be one more Python worker for a task."""
        n = np.minimum(n, (1 << 32) - 1).astype("<u4")
        raw = np.packbits(n > most, bitorder="little").tobytes() if last else zlib.compress(n.tobytes(), 1)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "g": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([raw], pa.binary())})

    kind = "slice int, g long, counts binary"
    sums = parts.withColumn("g", F.pmod(F.xxhash64("counts"), F.lit(groups))).groupBy("slice", "g").applyInArrow(start(groups == 1), kind)
    while groups > 1:
        groups = -(-groups // 16)
        sums = sums.withColumn("g", F.pmod("g", F.lit(groups))).groupBy("slice", "g").applyInArrow(add(groups == 1), kind)
    found = np.zeros((SLICES, each // 64), np.uint64)
    for r in sums.select("slice", "counts").collect():  # SLICES rows
        found[r["slice"]] = np.frombuffer(r["counts"], np.uint64)
    return found


def prefixes(docs: DataFrame, frequent: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """id, n and the prefix, in order: shingles in other cells by value, then those in frequent cells by value."""
    some = bool(frequent.any())
    each = frequent.shape[1] * 64

    def shape(ids, sets):
        out = []
        for s in sets:
            p = prefix_size(len(s)) if len(s) else 0
            if some and len(s):
                a = (s & np.uint64(MOST_CELLS - 1)).astype(np.int64)
                inside = a // SLICES & (each - 1)
                hot = (frequent[a % SLICES, inside >> 6] >> (inside & 63).astype(np.uint64)) & np.uint64(1)
                if hot[:p].any():
                    s = s[np.argsort(hot, kind="stable")]
            out.append(s[:p])
        return {"id": ids, "n": pa.array([len(s) for s in sets], pa.int64()), "prefix": list_array(_signed(np.concatenate([*out, np.zeros(0, np.uint64)])), np.array([len(x) for x in out]))}

    return _sets(docs, id_col, text_col, shape, "id long, n long, prefix array<long>")


def _sketch(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str, wanted: np.ndarray) -> DataFrame:
    """id and sketch of the whole sets of the wanted documents."""
    return _sets(docs, id_col, text_col, lambda ids, sets: {"id": ids.cast(pa.int64()), "sketch": pa.array([_sketch(s) for s in sets], pa.binary())}, "id long, sketch binary", wanted).dropDuplicates(["id"])


def _could_link(c, na, nb):
    """Whether c common shingles in both prefixes leave room for the overlap that sizes na and nb ask for."""
    least, most = np.minimum(na, nb), np.maximum(na, nb)
    # overlap >= t / (1 + t) * (na + nb); shingles behind the earlier end of the two prefixes are behind one prefix
    asked = (NUM * (na + nb) + NUM + DEN - 1) // (NUM + DEN)
    behind = np.minimum(least - c, np.maximum(na - prefix_size(na), nb - prefix_size(nb)))
    return (DEN * least >= NUM * most) & (c + behind >= asked)


def short_and_long(incidence: DataFrame) -> DataFrame:
    """Pairs of short lists, as (kind 0, a, b, na, nb, count), and members of long ones, as (kind 1, shingle, id, 0, n, 0).

    incidence: s, id and n, partitioned and sorted by s."""

    def run(batches):
        held: list[np.ndarray] = []

        def out(t: np.ndarray):
            first = np.flatnonzero(np.append(True, t[1:, 0] != t[:-1, 0]))
            size = np.diff(np.append(first, len(t)))
            rows = []
            for k in range(2, ALL_PAIRS + 1):
                at = first[size == k]
                if at.size:
                    for i in range(k):
                        for j in range(i + 1, k):
                            x, y = t[at + i], t[at + j]
                            swap = x[:, 1] > y[:, 1]
                            x[swap], y[swap] = y[swap], x[swap].copy()
                            ok = (DEN * np.minimum(x[:, 2], y[:, 2]) >= NUM * np.maximum(x[:, 2], y[:, 2])) & (x[:, 1] != y[:, 1])
                            rows.append(np.stack([x[ok, 1], y[ok, 1], x[ok, 2], y[ok, 2]], 1))
            found = []
            if rows and len(all_ := np.concatenate(rows)):
                all_ = all_[np.lexsort((all_[:, 1], all_[:, 0]))]
                at = np.flatnonzero(np.append(True, (all_[1:, :2] != all_[:-1, :2]).any(1)))
                n = np.diff(np.append(at, len(all_)))
                z = np.zeros(len(at), np.int64)
                found.append(np.column_stack([z, all_[at], n]))
            long = np.repeat(size > ALL_PAIRS, size)
            if long.any():
                x = t[long]
                z = np.zeros(len(x), np.int64)
                found.append(np.column_stack([z + 1, x[:, 0], x[:, 1], z, x[:, 2], z]))
            for x in found:
                for a in range(0, len(x), 50_000):
                    y = np.ascontiguousarray(x[a : a + 50_000].T)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in y], names=["kind", "a", "b", "na", "nb", "c"])

        for batch in batches:
            t = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
            t = np.concatenate([*held, t])
            last = np.searchsorted(t[:, 0], t[-1, 0], "left") if len(t) else 0
            # a long list goes out piece by piece: all but one row of a piece is long by itself
            if last == 0 and len(t) > 200_000:
                x = t[:-ALL_PAIRS - 1]
                yield from out(x)
                held = [t[len(x) :]]
            else:
                if last:
                    yield from out(t[:last])
                held = [t[last:]]
        if held and len(held[0]):
            yield from out(held[0])
        release()

    return incidence.select("s", "id", "n").mapInArrow(run, "kind long, a long, b long, na long, nb long, c long")


def _matched(pairs: DataFrame, lists: DataFrame, column: str, keep) -> DataFrame:
    """The pairs (a, b) that keep(list of a, list of b, n of a, n of b) holds for. lists: id, n and `column`."""
    side = lambda x: lists.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col(column).alias(f"s{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            sa, sb = batch.column(4), batch.column(5)
            c = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                x = np.sort(np.concatenate([sa[i].values.to_numpy(), sb[i].values.to_numpy()]))
                c[i] = (x[1:] == x[:-1]).sum()
            ok = pa.array(keep(c, na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])
        release()

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs that link, by their whole sets, which are taken from the texts again: of these documents alone. Stored."""
    shape = lambda i, sets: {"id": i.cast(pa.int64()), "n": pa.array([len(x) for x in sets], pa.int64()), "s": list_array(_signed(np.concatenate([*sets, np.zeros(0, np.uint64)])), np.array([len(x) for x in sets]))}
    sets = stored(_sets(docs, id_col, text_col, shape, "id long, n long, s array<long>", id_filter(_ids(pairs))).dropDuplicates(["id"]))
    out = stored(_matched(pairs, sets, "s", lambda c, na, nb: DEN * c >= NUM * (na + nb - c)))
    discard(sets)
    return out


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id reachable, of ids in edges (a, b), by alternating large-star and small-star steps. Stored.

    Every step is a grouping that combines on the map side and a join back; it ends when a round changes nothing."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    told = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stored(small)
        discard(before)
        sum_ = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(sum_) == told:
            out = now.withColumnsRenamed({"u": "id", "v": "root"})
            out._tidemark_path = now._tidemark_path
            return out
        told = tuple(sum_)


def _product(ta: np.ndarray, tb: np.ndarray, oa: np.ndarray, ob: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Counts of common shingles of the documents of two blocks. ta, tb: shingles; oa, ob: whose they are."""
    u, inverse = np.unique(np.concatenate([ta, tb]), return_inverse=True)
    ia, ib = inverse[: len(ta)], inverse[len(ta) :]
    ca, cb = np.bincount(ia, minlength=len(u)), np.bincount(ib, minlength=len(u))
    out = np.zeros((na, nb), np.float32)
    dense = np.flatnonzero((ca * cb) > 256)
    for at in range(0, len(dense), 512):
        col = np.full(len(u), -1)
        col[dense[at : at + 512]] = np.arange(len(dense[at : at + 512]))
        a, b = np.zeros((na, 512), np.float32), np.zeros((nb, 512), np.float32)
        k, j = col[ia] >= 0, col[ib] >= 0
        a[oa[k], col[ia[k]]] = 1
        b[ob[j], col[ib[j]]] = 1
        out += a @ b.T
    thin = (ca > 0) & (cb > 0) & (ca * cb <= 256)
    k, j = thin[ia], thin[ib]
    ka, kb = ia[k], ib[j]
    oa, ob = oa[k][np.argsort(ka, kind="stable")], ob[j][np.argsort(kb, kind="stable")]
    ca, cb = ca[thin], cb[thin]
    if len(ca):
        sa, sb = np.cumsum(ca) - ca, np.cumsum(cb) - cb
        each = ca * cb
        which = np.repeat(np.arange(len(each)), each)
        nth = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        np.add.at(out, (oa[sa[which] + nth // cb[which]], ob[sb[which] + nth % cb[which]]), 1)
    return out


def bundled(members: DataFrame) -> DataFrame:
    """members (s, id, n, root) with shingles of much the same documents as one: s is the document of least hash of its members.

    Documents that share a shingle share its bundle. Members of a bundle of more than a block have a step, a class of
    sizes: only those of the same step or of neighbouring ones can link."""
    least = stored(members.groupBy("s").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("l")).select("s", F.col("l.id").alias("g")))
    rows = stored(members.join(least, "s").select(F.col("g").alias("s"), "id", "n", "root").distinct())
    sizes = stored(rows.groupBy("s").agg(F.count(F.lit(1)).alias("size")))
    return rows.join(sizes, "s").select("s", "id", "n", "root", F.when(F.col("size") > BLOCK, _step()).otherwise(0).alias("step"))


def _sketches_allow(a: np.ndarray, b: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether sets with the sketches in the rows of a and b can have so many shingles in common. A full cell tells nothing."""
    least = np.minimum(a, b)
    return (least.sum(1, dtype=np.int32) >= asked) | (least.max(1) == 255)


def block_product(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents of different components that share a shingle of a prefix and pass the bounds.

    members: s, id, n, root and step, stored. lists: id, prefix and sketch. The members of a step of s fall into blocks
    of about BLOCK; a task multiplies two blocks of one step, or of neighbouring ones. Of a pair with several s in
    common, each may hand it on."""
    sizes = members.groupBy("s", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("k"))
    blocks = stored(sizes.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("step", "k"))).alias("k")))  # a step for each factor of DEN / NUM in size
    rows = members.join(blocks, "s").withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")[F.col("step")]))
    own, step = F.col("own"), F.col("step")
    others = lambda at: F.when(F.col("k")[at].isNull(), F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("k")[at], F.lit(1)) - 1))
    task = lambda low, high, i, j, left: F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"), left.alias("left"))
    same = F.transform(others(step), lambda o: task(step, step, F.least(own, o), F.greatest(own, o), own <= o))
    above = F.transform(others(step + 1), lambda o: task(step, step + 1, own, o, F.lit(True)))
    below = F.transform(others(step - 1), lambda o: task(step - 1, step, o, own, F.lit(False)))
    rows = rows.select("s", "id", "n", "root", F.explode(F.concat(same, above, below)).alias("t")).select("s", "t.*", "id", "n", "root").join(lists, "id")

    def run(t: pa.Table) -> pa.Table:
        diagonal = t["low"][0] == t["high"][0] and t["i"][0] == t["j"][0]
        ids, n, root = (t[c].to_numpy() for c in ("id", "n", "root"))
        prefix = t["prefix"].combine_chunks()
        size = np.diff(prefix.offsets.to_numpy())
        flat, of = prefix.flatten().to_numpy(), np.repeat(np.arange(len(ids)), size)
        left = t["left"].to_numpy(zero_copy_only=False).astype(bool)
        right = left if diagonal else ~left
        place = np.zeros(len(ids), np.int64)
        place[left] = np.arange(left.sum())
        if not diagonal:
            place[right] = np.arange(right.sum())
        l, r = left[of], right[of]
        c = _product(flat[l], flat[r], place[of[l]], place[of[r]], int(left.sum()), int(right.sum())).astype(np.int64)
        ok = (c > 0) & (root[left][:, None] != root[right][None, :]) & _could_link(c, n[left][:, None], n[right][None, :])
        if diagonal:
            ok = np.triu(ok)
        x, y = np.nonzero(ok)
        told = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        tl, tr, nl, nr = told[left], told[right], n[left], n[right]
        asked = (NUM * (nl[x] + nr[y]) + NUM + DEN - 1) // (NUM + DEN)
        some = [_sketches_allow(tl[x[k : k + STRIP]], tr[y[k : k + STRIP]], asked[k : k + STRIP]) for k in range(0, len(x), STRIP)]
        ok = np.concatenate([*some, np.zeros(0, bool)])
        a, b = ids[left][x[ok]], ids[right][y[ok]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("s", "low", "high", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of each document."""
    told = stored(summaries(docs, id_col, text_col))
    rows = told.where("slice IS NULL").select("id", "n", "sig1", "sig2")
    same = ["n", "sig1", "sig2"]
    classes = stored(rows.where("n > 0 AND id IS NOT NULL").groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    rep = F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))
    member = stored(join_groups(rows, classes, same, "size", "left").select("id", "n", rep.alias("rep")))
    frequent = frequent_cells(told)
    discard(told, classes)
    reps = member.where("n > 0 AND id = rep").select("id").distinct()
    incident = stored(prefixes(docs, frequent, id_col, text_col).join(reps, "id", "left_semi").dropDuplicates(["id"]))
    incidence = incident.select(F.explode("prefix").alias("s"), "id", "n").repartition("s").sortWithinPartitions("s", "n", "id")
    found = stored(short_and_long(incidence))

    counted = found.where("kind = 0").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))
    short = stored(counted.where(_bound_sql()).select("a", "b"))
    long = stored(found.where("kind = 1").select(F.col("a").alias("s"), F.col("b").alias("id"), F.col("nb").alias("n")))
    discard(found)
    pairs = stored(short.unionByName(_star_pairs(long.withColumn("root", F.col("id")), 0, incident)).distinct())
    discard(short)
    links = verified(pairs, docs, id_col, text_col)
    roots = components(links)
    discard(links)
    for turn in range(1, STARS + 2):
        open_ = _unsettled(long, roots)
        if open_.isEmpty():
            break
        if turn <= STARS:
            more = _star_pairs(open_, turn, incident)
        else:
            members = stored(bundled(open_))
            wanted = id_filter(members.select("id").distinct())
            some = stored(_only(incident.select("id", "prefix"), wanted))
            lists = stored(some.join(sketches(docs, id_col, text_col, wanted), "id"))
            discard(some)
            more = block_product(members, lists)
        more = stored(more.join(pairs, ["a", "b"], "left_anti"))
        discard(open_)
        if more.isEmpty():
            continue
        known = stored(pairs.unionByName(more))
        new = verified(more, docs, id_col, text_col)
        discard(pairs, more)
        pairs, before = known, roots
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(new))
        discard(before, new)
    discard(incident, long, pairs)
    out = member.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def _bound_sql():
    """_could_link of columns c, na and nb."""
    na, nb, c = F.col("na"), F.col("nb"), F.col("c")
    least = F.least(na, nb)
    size = lambda n: n - F.expr(f"({NUM} * {'na' if n is na else 'nb'} + {DEN - 1}) div {DEN}") + 1
    asked = F.expr(f"({NUM} * (na + nb) + {NUM + DEN - 1}) div {NUM + DEN}")
    return c + F.least(least - c, F.greatest(na - size(na), nb - size(nb))) >= asked


def _step(shift: float = 0.0):
    """The class of sizes of column n: sizes that can link are of the same class or of neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(DEN / NUM))) + F.lit(shift)).cast("int")


def _stars(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of each long shingle's leader and its members of other components and like size.

    Leaders differ by size class, so that each is as large as what it leads, and by turn. The leader is found by a
    grouping that combines on the map side."""
    rows = members.withColumn("step", _step(0.5 * (turn % 2))).withColumn("r", F.xxhash64("id", F.lit(turn)))
    leaders = rows.groupBy("s", "step").agg(F.min_by(F.struct("id", "n", "root"), F.struct("r", "id")).alias("l"))
    # a leader also meets the next class, whose sizes may be alike
    leaders = stored(leaders.select("s", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"), "l"))
    met = rows.join(leaders, ["s", "step"]).where(f"id <> l.id AND root <> l.root AND {DEN} * least(n, l.n) >= {NUM} * greatest(n, l.n)")
    return met.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b")).distinct()


def _star_pairs(members: DataFrame, turn: int, incident: DataFrame) -> DataFrame:
    """The pairs of _stars() that the common shingles of their prefixes leave a chance. Stored."""
    met = stored(_stars(members, turn))
    lists = stored(_only(incident, id_filter(_ids(met))))  # a stage of its own: a task has one Python worker
    out = stored(_matched(met, lists, "prefix", _could_link))
    discard(met, lists)
    return out


def _unsettled(long: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (s, id, n, root) of the long shingles that lie in several components. Stored."""
    rows = stored(long.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    many = stored(rows.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("s"))
    out = stored(rows.join(many, "s", "left_semi").select("s", "id", "n", "root"))
    discard(rows, many)
    return out


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
