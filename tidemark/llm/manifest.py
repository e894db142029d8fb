"""Merkle manifest of a dataset: a tree of hashes for each group of rows, their roots under one root, and each row's proof.

A leaf is the SHA-256 of a row's fields, each `-` if null, else its length in bytes, a colon and its value. Within a
group leaves stand in order of id (null first, then by leaf); every FANOUT consecutive nodes have as parent the SHA-256
of their digests as text, level by level until one node is left, the subroot. Subroots in order of their group (null
first) are joined in the same way below the root.

Every level is a DataFrame. Leaves are numbered first: the table is dealt into ranges of (group, id), so that no group is
one task's, rows are numbered within their range, and a table with a row for each (range, group) says how many of the
group's rows lie in ranges before. A parent's index is its children's index divided by FANOUT; a grouped, sorted array of
at most FANOUT children is hashed into it. Siblings are appended by joins from the roots down, so the long lists meet the
many leaves last: a parent's array, which holds the siblings of all its children, meets the parent's own list, and
children come out with theirs. No group of rows is ever gathered, no digest goes to the driver but the root.

Null ids, null groups and null fields have their place as said; rows that repeat are leaves each, next to one another;
the empty table gives an empty result. A very long text is hashed whole in its row. Other columns are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

FANOUT = 8
DOCUMENT = ("doc_id", "source", "lang", "n_chars", "text")
#: What a sibling list holds for each level: digests left of the node and right of it, concatenated.
STEP = "array<struct<left:string,right:string>>"


def leaf(*fields: Column) -> Column:
    """Digest of a row's fields."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def group_key(group: Column) -> Column:
    """A group as text that isn't null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with _group) stored with _i, their place in their group by `order` from 0, and _n, the group's size."""
    low = (1 << 33) - 1  # an id is the partition's number, then the row's place in it
    placed = stored(rows.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order).withColumn("_id", F.monotonically_increasing_id()).select("*", F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(low).alias("_row")).drop("_id"))
    # a row for each group in each range: at most as many as ranges and groups together
    pieces = placed.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_here"), F.min("_row").alias("_first"))
    of = Window.partitionBy("_group")
    pieces = pieces.withColumns({"_before": F.sum("_here").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_here"), "_n": F.sum("_here").over(of)})
    return placed.join(pieces, ["_group", "_range"]).withColumn("_i", F.col("_before") + F.col("_row") - F.col("_first")).drop("_range", "_row", "_here", "_first", "_before")


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables of parents from the leaves up: _group, _i, _n (nodes of the group on this level), digest, and kids, the
    array of children (_i, digest, row). nodes: _group, _i, _n, digest and row, any struct. Few levels: a logarithm."""
    most, out = nodes.agg(F.max("_n")).first()[0] or 0, []
    while most > 1:
        parent = [F.floor(F.col("_i") / fanout).alias("_i"), F.ceil(F.col("_n") / fanout).alias("_n")]
        kids = F.sort_array(F.collect_list(F.struct("_i", "digest", *(["row"] if not out else []))))
        above = nodes.where("_n > 1").groupBy("_group", *parent).agg(kids.alias("kids"))
        nodes = stored(above.withColumn("digest", F.sha2(F.concat_ws("", "kids.digest"), 256)))
        out.append(nodes)
        most = math.ceil(most / fanout)
    return out


def roots(nodes: DataFrame, parents: list[DataFrame]) -> DataFrame:
    """_group, digest and the height at which a group's one node stands."""
    lone = lambda df, h: df.where("_n = 1").select("_group", "digest", F.lit(h).alias("height"))
    out = lone(nodes, 0)
    for h, df in enumerate(parents, 1):
        out = out.unionByName(lone(df, h))
    return out


def with_siblings(nodes: DataFrame, parents: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Every node of `nodes` as (_group, digest, row, siblings, subroot). tops: _group, height, subroot, and siblings, those above the group's root."""
    here = lambda h: tops.where(F.col("height") == h).select("_group", F.lit(0).cast("long").alias("_i"), "siblings", "subroot")
    listed = None
    for h in range(len(parents), 0, -1):
        known = here(h) if listed is None else here(h).unionByName(listed)
        held = parents[h - 1].drop("digest", "_n").join(known, ["_group", "_i"])
        each = held.select("_group", "siblings", "subroot", "kids", F.posexplode("kids").alias("_at", "kid"))
        # an only child has two empty sides: its parent hashes it alone
        digests, at = F.col("kids.digest"), F.col("_at")
        step = F.struct(F.concat_ws("", F.slice(digests, F.lit(1), at)).alias("left"), F.concat_ws("", F.slice(digests, at + 2, F.size(digests))).alias("right"))
        more = ["kid.row"] if h == 1 else []
        listed = each.select("_group", "kid._i", "kid.digest", *more, F.concat(F.array(step), "siblings").alias("siblings"), "subroot")
        if h > 1:
            listed = listed.drop("digest")
    lone = nodes.where("_n = 1").join(here(0).drop("_i"), "_group").select("_group", "digest", "row", "siblings", "subroot")
    return lone if listed is None else lone.unionByName(listed.drop("_i"))


def fold(digest: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(siblings, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(siblings: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(siblings, lambda s: F.concat(s["left"], s["right"]))), 256)


def manifest(leaves: DataFrame, group_col: str, id_col: str, fanout: int = FANOUT) -> DataFrame:
    """leaves (a column `digest` among others) with siblings (an array, level by level), subroot and root.

    Columns of leaves that are named like these three give way to them."""
    given = [c for c in leaves.columns if c.lower() not in ("siblings", "subroot", "root")]
    flat = stored(leaves.select(group_key(F.col(group_col)).alias("_group"), F.col(id_col).alias("_order"), "digest", F.struct(*given).alias("row")))
    nodes = numbered(flat, ["_order", "digest"]).drop("_order")
    parents = levels(nodes, fanout)
    found = stored(roots(nodes, parents))
    # the groups' roots are the leaves of one more tree
    subroots = found.select(F.lit("").alias("_group"), F.col("_group").alias("_order"), "digest", F.struct("_group", "height", F.col("digest").alias("subroot")).alias("row"))
    tops = numbered(subroots, ["_order"]).drop("_order")
    above = levels(tops, fanout)
    root = roots(tops, above).first()
    none = F.array().cast(STEP)
    one = leaves.sparkSession.range(1).select(F.lit("").alias("_group"), F.lit(len(above)).alias("height"), none.alias("siblings"), F.lit("").alias("subroot"))
    groups = with_siblings(tops, above, one).select("row.*", "siblings")
    discard(flat)
    return with_siblings(nodes, parents, groups).select("row.*", "siblings", "subroot", F.lit(root.digest if root else None).cast("string").alias("root"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in DOCUMENT]
    changed = leaf(*fields[:-1], F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed)
    out = manifest(docs.select("doc_id", "lang", leaf(*fields).alias("digest"), tampered.alias("tampered")), "lang", "doc_id")
    folded = fold(F.coalesce("tampered", "digest"), F.col("siblings"))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("siblings")).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


_PART = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_HEAD = " || ".join(_PART.format(c) for c in DOCUMENT[:-1])
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str) -> str:
    """All nodes above leaves (g, i, n, digest), and for each what stands left and right of it."""
    sides = "coalesce(string_agg(digest, '' ORDER BY i) OVER (PARTITION BY g, h, i // 8 ORDER BY i ROWS BETWEEN {0}), '')"
    return f"""{name} AS (SELECT g, 0 AS h, i, n, digest FROM {leaves} UNION ALL SELECT g, h + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, h, n, i // 8),
{name}_sides AS MATERIALIZED (SELECT g, h, i, n, {sides.format("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS l, {sides.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS r FROM {name})"""


def _climb(name: str, tree: str, start: str) -> str:
    step = lambda acc: f"sha256(l || {acc} || r)"
    return f"""{name} AS (SELECT doc_id, g, 0 AS h, i, n, leaf, acc, sib FROM {start}
UNION ALL SELECT doc_id, p.g, p.h + 1, p.i // 8, (p.n + 7) // 8, leaf, {step("acc")}, sib || l || r FROM {name} AS p JOIN {tree}_sides AS s ON p.g = s.g AND p.h = s.h AND p.i = s.i WHERE p.n > 1)"""


OP11_SQL = f"""
WITH RECURSIVE bits AS (SELECT range AS b, 0 AS k, CAST(range AS UBIGINT) AS x FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS UBIGINT)) ELSE x // 2 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(x ORDER BY b) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256({_HEAD} || {_PART.format("text")}) AS digest, sha256({_HEAD} || {_PART.format(_LOWER)}) AS changed,
  xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda c, b: xor(c // 256, t[CAST(1 + xor(c % 256, b) AS BIGINT)])), CAST(4294967295 AS UBIGINT)) AS crc FROM documents, crc),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree("nodes", "leaves")},
subs AS MATERIALIZED (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, digest FROM nodes WHERE n = 1),
{_tree("tops", "subs")},
{_climb("up", "nodes", "(SELECT doc_id, g, i, n, digest AS leaf, CASE WHEN crc % 3 = 0 THEN changed ELSE digest END AS acc, '' AS sib FROM leaves)")},
met AS MATERIALIZED (SELECT doc_id, s.g, s.i, s.n, leaf, acc, sib, s.digest AS subroot FROM up JOIN subs AS s ON up.g = s.lang WHERE up.n = 1),
{_climb("climb", "tops", "met")}
SELECT c.doc_id, c.leaf, m.subroot, t.digest AS root, sha256(c.sib) AS proof_sha256, c.acc AS folded_root, c.acc = t.digest AS verified FROM climb AS c JOIN met AS m ON c.doc_id IS NOT DISTINCT FROM m.doc_id AND c.leaf = m.leaf, tops AS t WHERE c.n = 1 AND t.n = 1
"""
