"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after every run of `[\\x20\\x09-\\x0D]` became one space; null counts as
empty. Each level reads what the level before left: only rows whose length occurs again have a prefix hashed, and only
rows whose length and prefix occur again have their full content hashed; the others are unique already. What a level
hands to the next is a table of cells (hashes of keys that occur again) of at most CELLS rows, whatever the corpus
holds, so it is broadcast and no text is ever shuffled. Two keys in one cell let a row through needlessly and change no
result: the full hash decides.

The smallest id stays; of rows that repeat an id, each one is kept or dropped alike (they share the id that stays). A
null id orders after all others. An empty table gives an empty result. Other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, stored, table

PREFIX = 64
#: Cells that keys of a level fall into: the bound of what is broadcast.
CELLS = 1 << 20


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _cell(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(CELLS))


def _again(rows: DataFrame, key: list[str]) -> DataFrame:
    """Cells of the keys that occur more than once. Counts combine on the map side, so a hot key sends one row for each task."""
    often = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return stored(often.select(_cell(*map(F.col, key)).alias("_cell")).distinct())


def _kept(rows: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key lies in one of the cells (at most CELLS, hence the broadcast)."""
    return rows.withColumn("_cell", _cell(*map(F.col, key))).join(F.broadcast(cells), "_cell", "left_semi").drop("_cell")


def refined(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows as (_id, _norm, _len), and the cells of lengths, and of lengths with prefixes, that occur again."""
    rows = df.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm")).withColumn("_len", F.length("_norm"))
    lengths = _again(rows, ["_len"])
    prefixed = _kept(rows, lengths, ["_len"]).withColumn("_prefix", F.xxhash64(F.substring("_norm", 1, PREFIX)))
    return rows, lengths, _again(prefixed, ["_len", "_prefix"])


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str | None = None) -> DataFrame:
    """One row for each input row: its id, keep_id, group_size, kept and full_hash (null where a text is unique already by length and prefix).

    digest: name of one more column, the SHA-256 of every normalised text; grouping doesn't use it."""
    rows, lengths, prefixes = refined(df, id_col, text_col)
    by_length = rows.withColumn("_cell", _cell(F.col("_len"))).join(F.broadcast(lengths.withColumn("_some", F.lit(True))), "_cell", "left")
    prefix = F.when(F.col("_some"), F.xxhash64(F.substring("_norm", 1, PREFIX)))
    by_prefix = by_length.withColumn("_cell", F.when(F.col("_some"), _cell(F.col("_len"), prefix))).join(F.broadcast(prefixes.withColumn("_more", F.lit(True))), "_cell", "left")
    full = F.sha2(F.col("_norm"), 256)
    more = {digest: full} if digest else {}
    hashed = stored(by_prefix.select("_id", F.when(F.col("_more"), full).alias("full_hash"), *[v.alias(k) for k, v in more.items()]))
    some = hashed.where("full_hash IS NOT NULL")
    groups = some.groupBy("full_hash").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # texts that are unique already have no hash: in the join they would all meet in one task
    alone = hashed.where("full_hash IS NULL").withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("long")})
    out = join_groups(some, stored(groups), "full_hash", "group_size", "left").unionByName(alone)
    keep = F.coalesce("keep_id", "_id")
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("_id")).alias("kept"), "full_hash", *more)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """The rows of df, all columns, whose text no row with a smaller id repeats.

    Rows that repeat an id that stays all stay; with `once`, one row of each id (or none) and text does: the least by a
    hash of its columns."""
    groups = exact_groups(df, id_col, text_col).where("full_hash IS NOT NULL")
    if once:
        groups = stored(groups)
    key = [F.xxhash64(F.col(id_col), "full_hash").alias("_key"), F.col(id_col).alias("_dropped"), F.col("full_hash").alias("_dropped_hash")]
    dropped = groups.where(~F.col("kept")).select(*key, F.lit(False).alias("_twice")).distinct()
    if once:
        # counts combine on the map side, so an id and text that repeat often send one row for each task
        twice = groups.where("kept").groupBy(id_col, "full_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        dropped = dropped.unionByName(twice.select(*key, F.lit(True).alias("_twice")))
    dropped = stored(dropped)
    # by id and text: rows that share an id, or have none, may differ in text
    cells = stored(dropped.select(_cell(F.col("_dropped")).alias("_cell")).distinct())
    names = df.columns
    plain = [F.col(f"`{f.name}`") for f in df.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(*plain).alias("_order")).withColumn("_cell", _cell(F.col("_id")))
    marked = marked.join(F.broadcast(cells.withColumn("_some", F.lit(True))), "_cell", "left")
    # a row in no cell of a dropped id stays as it is; only the others have their text hashed and meet the dropped ones
    asked = marked.where("_some").withColumn("_hash", F.sha2(normalised(F.col("_text")), 256)).withColumn("_key", F.xxhash64("_id", "_hash"))
    same = (asked["_key"] == dropped["_key"]) & asked["_id"].eqNullSafe(dropped["_dropped"]) & (asked["_hash"] == dropped["_dropped_hash"])
    out = asked.join(dropped, same, "left_anti").select("_row").union(marked.where("_some IS NULL").select("_row"))
    if once:
        met = asked.join(dropped.where("_twice"), same, "left_semi").groupBy("_key", "_id", "_hash").agg(F.min_by("_row", "_order").alias("_row"))
        out = out.union(met.select("_row"))
    return out.select("_row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest="text_sha256").drop("full_hash")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
