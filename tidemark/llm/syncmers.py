"""Document fingerprints from closed syncmers, in DataFrame functions only.

A window of K code points is an anchor when the least hash of its runs of S code points stands at its first or last
place. Whether a window is one depends on its own code points alone, so an edit elsewhere moves no anchor: those before
an edit keep hash and place, those behind it hash and distance to one another. A text with fewer than K code points has
one anchor of the whole, as has one without any other.

Matching is by place: an entry binds an anchor's hash to the distance from its place to the next anchor's, so entries of
two texts are equal where the same two anchors begin equally far apart, wherever in the texts that is. The fingerprint
is the entries in hexadecimal, in order of place. Likeness is the Dice share of distinct entries in common, by the one
rule for every length and whether or not a text has spaces. Two empty texts are alike (1), an empty and another are not
(0).

Null text counts as empty. Ids are whole numbers. Repeated rows and equal ids: the next document is the next row in order
of id, then text hash. A null id orders first. An empty table gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Code points of a window, and of the runs whose hashes are compared.
K, S = 8, 2
#: Ranges of ids with about equal counts of rows, and rows for each window partition that looks up the following document.
RANGES, BUCKET_ROWS = 512, 256


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _points(text: Column) -> Column:
    return F.slice(F.split(text, ""), F.lit(1), F.length(text))


def anchors(text: Column) -> Column:
    """struct(at, key) of arrays: places of the anchors, ascending, and their hashes."""
    m = K - S + 1

    def edge(h: Column, i: Column) -> Column:
        middle = F.least(*[F.get(h, i + j) for j in range(1, m - 1)])
        return F.least(F.get(h, i), F.get(h, i + m - 1)) <= middle

    def of(h: Column) -> Column:
        windows = F.when(F.size(h) >= K, F.sequence(F.lit(0), F.size(h) - K)).otherwise(F.array().cast("array<int>"))
        key = lambda i: F.hash(*[F.get(h, i + j) for j in range(0, m, S)])
        return _let(F.filter(windows, lambda i: edge(h, i)), lambda at: F.struct(at.alias("at"), F.transform(at, key).alias("key")))

    # the last S - 1 runs are cut short; no window reaches them
    runs = lambda points: F.transform(points, lambda x, i: F.xxhash64(x, *[F.get(points, i + j) for j in range(1, S)]))
    return _let(_let(_points(text), runs), of)


def _bound(at: Column, key: Column, after: Column) -> Column:
    """The hash of each anchor with the distance to the next one, the last one's to `after` (null: none follows)."""
    return F.transform(at, lambda i, nth: F.hash(F.get(key, nth), F.coalesce(F.get(at, nth + 1), after) - i))


def _or_whole(entry: Column, text: Column) -> Column:
    """entry; of a text without an anchor, the hash of the whole."""
    whole = F.when(F.length(text) > 0, F.array(F.hash(text))).otherwise(F.array().cast("array<int>"))
    return _let(entry, lambda e: F.when(F.size(e) > 0, e).otherwise(whole))


def entries(text: Column, found: Column) -> Column:
    """The hash of each anchor with the distance to the next one; of a text without an anchor, that of the whole."""
    return _or_whole(_let(found, lambda x: _bound(x["at"], x["key"], F.lit(None).cast("int"))), text)


def spliced(text: Column, found: Column, entry: Column, cut: Column, other: Column, found_other: Column, entry_other: Column, length: Column) -> Column:
    """entries() of the first `cut` code points of text, followed by the first `length` of other, from those of both.

    Anchors depend on their own code points alone, so only the windows across the cut are looked at anew, and only the
    last anchor before it, those across it and the last one of all are bound anew."""
    first = F.greatest(F.lit(0), cut - (K - 1))
    edited = F.concat(F.substring(text, F.lit(1), cut), F.substring(other, F.lit(1), length))
    across = anchors(F.concat(F.substring(text, first + 1, cut - first), F.substring(other, F.lit(1), F.least(length, F.lit(K - 1)))))
    upto = lambda x, end: F.size(F.filter(x["at"], lambda i: i + K <= end))  # noqa: E731; end must be a column, not computed here
    parts = F.struct(upto(found, cut).alias("l"), across.alias("m"), upto(found_other, length).alias("r"))

    def of(p: Column) -> Column:
        none = F.array().cast("array<int>")
        last = lambda x, n: F.when(n > 0, F.array(F.get(x, n - 1))).otherwise(none)
        before = lambda e, n: F.slice(e, F.lit(1), F.greatest(n - 1, F.lit(0)))
        at = F.concat(last(found["at"], p["l"]), F.transform(p["m"]["at"], lambda i: i + first))
        key = F.concat(last(found["key"], p["l"]), p["m"]["key"])
        after = F.when(p["r"] > 0, F.get(found_other["at"], F.lit(0)) + cut)
        middle = _let(F.struct(at.alias("at"), key.alias("key"), after.alias("after")), lambda x: _bound(x["at"], x["key"], x["after"]))
        end = F.when(p["r"] > 0, F.array(F.hash(F.get(found_other["key"], p["r"] - 1)))).otherwise(none)
        return F.concat(before(entry, p["l"]), middle, before(entry_other, p["r"]), end)

    return _or_whole(_let(parts, of), edited)


def fingerprint(entry: Column) -> Column:
    return F.array_join(F.transform(entry, lambda h: F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF))), " ")


def likeness(x: Column, y: Column, nx: Column | None = None, ny: Column | None = None) -> Column:
    """Dice share of two arrays of entries, 0 to 1. nx and ny: how many of each differ; if not given, all do."""
    nx, ny = F.size(x) if nx is None else nx, F.size(y) if ny is None else ny
    return F.when(nx + ny == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (nx + ny))


def _bucketed(df: DataFrame, id_col: str) -> DataFrame:
    """df with _range and _bucket, both ascending with the id: ranges of about equal counts, cut into buckets of about
    BUCKET_ROWS rows where the ids of a range are dense.

    The ranges' bounds are quantiles of all ids, so a far-off id widens the buckets of one range alone. Rows without an
    id have a range of their own, bucketed by their texts' hashes."""
    quantiles = F.percentile_approx(id_col, [i / RANGES for i in range(RANGES)], 20 * RANGES)
    low, high, n, cuts = df.agg(F.min(id_col), F.max(id_col), F.count(id_col), quantiles).first()
    bounds = sorted({low, *(cuts or ())} - {None}) or [0]
    share = max(1, n // len(bounds) // BUCKET_ROWS)
    widths = [max(1, -(-(b - a) // share)) for a, b in zip(bounds, [*bounds[1:], (high or 0) + 1])]
    longs = lambda v: F.lit(v).cast("array<decimal(20,0)>")
    key = F.col(id_col).cast("decimal(20,0)")
    range_ = F.size(F.filter(longs(bounds), lambda b: b <= key))
    inside = F.floor((key - F.element_at(longs(bounds), F.col("_range"))) / F.element_at(longs(widths), F.col("_range"))).cast("long")
    df = df.withColumn("_range", F.when(F.col(id_col).isNull(), 0).otherwise(range_))
    return df.withColumn("_bucket", F.when(F.col(id_col).isNull(), F.shiftright(F.xxhash64("text"), 50)).otherwise(inside))


def _after(keys: DataFrame) -> DataFrame:
    """_range, _bucket and the next pair of them that occurs, as _to_range and _to; the last one has the first."""
    seen = keys.select("_range", "_bucket").distinct()
    inside = seen.withColumn("_to", F.lead("_bucket").over(Window.partitionBy("_range").orderBy("_bucket")))
    firsts = seen.groupBy("_range").agg(F.min("_bucket").alias("_least"))
    around = Window.partitionBy(F.lit(0)).orderBy("_range")  # a row for each range
    head = F.struct(F.col("_range").alias("r"), F.col("_least").alias("b"))
    heads = firsts.select("_range", F.coalesce(F.lead(head).over(around), F.min(head).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_head"))
    joined = inside.join(heads, "_range")
    return joined.select("_range", "_bucket", F.when(F.col("_to").isNull(), F.col("_head.r")).otherwise(F.col("_range")).alias("_to_range"), F.coalesce("_to", "_head.b").alias("_to"))


def signed(text: Column) -> Column:
    """struct(found, entry, distinct): a text's anchors, its entries and how many of these differ, each computed once."""
    both = _let(anchors(text), lambda x: F.struct(x.alias("found"), entries(text, x).alias("entry")))
    return _let(both, lambda x: F.struct(x["found"].alias("found"), x["entry"].alias("entry"), F.size(F.array_distinct(x["entry"])).alias("distinct")))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and signed (what signed() finds of it); in next, text and signed of the following row by id, and of the
    first row for the last one.

    Each text is shuffled once to its bucket, alone; its anchors are found there, once, and the window hands them to the
    row before it in the same task. What a bucket's last row needs, the first row of the following bucket, is found from
    ids alone and joined to it."""
    tie = F.xxhash64("text")
    rows = _bucketed(df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")), id_col)
    at = ["_range", "_bucket"]
    ids = stored(rows.groupBy(*at).agg(F.min(id_col).alias("_id")))
    at_head = (rows["_range"] == ids["_range"]) & (rows["_bucket"] == ids["_bucket"]) & rows[id_col].eqNullSafe(ids["_id"])
    heads = rows.join(ids, at_head, "left_semi").groupBy(*at).agg(F.min_by("text", tie).alias("text"))
    heads = heads.withColumnsRenamed({"_range": "_to_range", "_bucket": "_to"})
    follow = stored(_after(ids).join(heads, ["_to_range", "_to"]).select(*at, F.struct("text", signed(F.col("text")).alias("signed")).alias("_head")))
    order = [F.col(id_col).asc_nulls_first(), F.col("_tie")]
    # sorted before the anchors are there, so the sort moves texts alone; the window asks for the same order
    placed = rows.withColumn("_tie", tie).repartition(*at).sortWithinPartitions(*at, *order)
    own = placed.select(id_col, *at, "_tie", F.struct("text", signed(F.col("text")).alias("signed")).alias("_own"))
    following = own.withColumn("_next", F.lead("_own").over(Window.partitionBy(*at).orderBy(*order)))
    return following.join(follow, at).select(id_col, "_own.*", F.coalesce("_next", "_head").alias("next"))


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    # lengths stand in columns of their own: within a lambda they would be counted for each anchor
    docs = with_next(table(spark, sf_dir, "documents")).withColumns({"n": n, "cut": n - half, "length": F.least(half, F.length("next.text"))})
    edited = F.concat(F.substring("text", F.lit(1), F.col("cut")), F.substring("next.text", F.lit(1), F.col("length")))
    both = spliced(F.col("text"), F.col("signed.found"), F.col("signed.entry"), F.col("cut"), F.col("next.text"), F.col("next.signed.found"), F.col("next.signed.entry"), F.col("length"))
    own = docs.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), F.col("signed.entry").alias("a"), F.col("signed.distinct").alias("na"), both.alias("e"), F.col("next.signed.entry").alias("x"), F.col("next.signed.distinct").alias("nx"))
    own = own.withColumn("de", F.array_distinct("e"))
    return own.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("de"), F.col("na")).alias("near_edited"), likeness(F.col("a"), F.col("x"), F.col("na"), F.col("nx")).alias("near_next"),
    )
