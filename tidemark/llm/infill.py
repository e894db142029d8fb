"""Fill-in-the-middle: texts cut at two ranks and put in another order behind sentinels.

A text is a row of units, by default its code points; any pattern can state what a unit is (words with the space behind
them, lines). A first pass over the matches counts them. Hashes of the id give two ranks from zero to that count; a
second pass advances a lazy match iterator to the smaller one, then on to the larger one, and reads where each match
ends. Neither pass stores a unit, so memory is that of the text and its result, whatever the number of units.

Form is plain, the text as it is, if it is empty, holds a sentinel already, or the third hash leaves it out; else spm
(suffix, prefix, middle) for a share of texts by the fourth, or psm. No sentinel can arise where parts meet, as `<` only
begins one, so `restored` cuts an output at its sentinels and is exact.

A null text counts as empty, a null id as the empty string. Rows stand alone: rows that repeat give equal results, equal
ids with other texts share their hashes, an empty table gives an empty one. A very long text is one row of work. Other
columns stay; those named like an output give way to it.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, table

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
CODE_POINT = r"(?s:.)"
WORD = r"\S+\s*|\s+"
SEED = 1
#: Of a hundred texts so many change their form, and of these so many put the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
FIELDS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_units", T.LongType()), T.StructField("middle_units", T.LongType()), T.StructField("output", T.StringType())]


def hashes(doc_id, seed: int = SEED) -> tuple[int, ...]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def count(unit: re.Pattern, text: str) -> int:
    n = 0
    for n, _ in enumerate(unit.finditer(text), 1):
        pass
    return n


def cuts(unit: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Where the units of ranks first <= second end, 0 for rank 0, from one pass that ends at the second."""
    matches, ends, done = unit.finditer(text), [], 0
    for rank in (first, second):
        if rank > done:
            at, done = next(islice(matches, rank - done - 1, None)).end(), rank
        ends.append(at if done else 0)
    return ends[0], ends[1]


def infill(text: str, h: tuple[int, ...], unit: re.Pattern, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """n, form, units of the prefix and of the middle, and the output."""
    n = count(unit, text)
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= changed:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = cuts(unit, text, first, second)
    if h[3] % 100 < suffix_first:
        form, out = "spm", (SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])
    else:
        form, out = "psm", (PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])
    return n, form, first, second - first, "".join(out)


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: int = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """df with n, form, prefix_units, middle_units (both null if plain) and output. unit: a pattern that matches one unit."""
    re.compile(unit)

    def run(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        pattern = re.compile(unit)
        rows = [infill(t or "", hashes(i, seed), pattern, changed, suffix_first) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
        return [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]

    return appended(df, [id_col, text_col], FIELDS, run)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of transform was made of."""
    parts = F.split(output, "|".join(SENTINELS))
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
