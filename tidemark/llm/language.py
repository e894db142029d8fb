"""Language identification by rank-order profiles of n-grams.

A profile is a language's PROFILE most frequent n-grams of 1 to 3 characters (lower-cased letters; every run of other
characters is one word boundary). A document's own most frequent n-grams are compared to each profile by out-of-place
distance: the sum of rank differences, PROFILE for an n-gram that a profile lacks. The least distance wins; of equal
ones the language that sorts first.

Null text and text without a letter give `und` and score 0. Training rows with null lang or text count for nothing; if
there is none, every document is `und`. Repeated rows count as often as they occur. Texts are read whole; a task holds
one chunk of a quarter of a megabyte, or one longer text. An empty table gives an empty result; other columns stay, those
named like an output give way to it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, table, text_chunks

PROFILE = 300
UNKNOWN = "und"
#: Bits of a code point, and the tags of grams of one and two characters.
BITS, ONE, TWO = 21, 0x1FFFFE, 0x1FFFFF


@cache
def letter_codes() -> np.ndarray:
    """For each code point 0 if it's no letter, else its lower case. Planes 4 and up hold no letters."""
    codes = np.zeros(0x110000, np.int64)
    for cp in range(0x40000):
        ch = chr(cp)
        if ch.isalpha():
            codes[cp] = ord(ch.lower()[0])
    return codes


def grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a text, with word boundaries as 0, as often as they occur.

    A code holds three fields of BITS bits; the first one of shorter grams is a tag that is no code point."""
    c = letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not c.any():
        return np.zeros(0, np.int64)
    c = np.concatenate([[0], c, [0]])
    c = c[(c > 0) | np.append(True, c[:-1] > 0)]
    one = c[c > 0]
    two = (c[:-1] << BITS) | c[1:]
    three = ((c[:-2] << 2 * BITS) | two[1:])[c[1:-1] > 0]
    return np.concatenate([one | ONE << 2 * BITS, two | TWO << 2 * BITS, three])


def counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def top(codes: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes, most frequent first, of equal ones the smaller code."""
    u, n = counts(codes)
    if len(u) > k:
        least = np.partition(n, len(n) - k)[len(n) - k]
        u, n = u[n >= least], n[n >= least]
    return u[np.argsort(-n, kind="stable")][:k]


def profiles(train: DataFrame, text_col: str = "text", lang_col: str = "lang", k: int = PROFILE) -> dict[str, list[int]]:
    """Each language's n-grams by rank, from all rows of train. At most k rows for each language reach the driver."""

    def run(batches):
        held: dict[str, list] = {}

        def merged(parts):
            u, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return u, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi, data, offs in text_chunks(batch.column(0)):
                raw = data.tobytes()
                new: dict[str, list] = {}
                for i in range(hi - lo):
                    if langs[lo + i] is not None:
                        new.setdefault(langs[lo + i], []).append(grams(raw[offs[i] : offs[i + 1]].decode()))
                for lang, parts in new.items():
                    held.setdefault(lang, []).append(counts(np.concatenate(parts)))
                    if len(held[lang]) > 16:
                        held[lang] = [merged(held[lang])]
        for lang, parts in held.items():
            u, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(n)], names=["lang", "gram", "n"])
        release()

    found = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(lang_col).cast("string")).mapInArrow(run, "lang string, gram long, n long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", rank).where(F.col("rank") <= k)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return out


def identify(df: DataFrame, learned: dict[str, list[int]], text_col: str = "text", pred: str = "lang_pred", score: str = "score", k: int = PROFILE) -> DataFrame:
    """df with two more columns: the language and a score of 0 to 1, one minus the distance's share of the largest possible.

    Columns of df that have these names are replaced."""
    names = sorted(learned)
    df = df.drop(pred, score)
    where = df.columns.index(text_col)

    def run(batches):
        known = np.unique(np.array([g for x in names for g in learned[x]], np.int64)) if names else np.zeros(0, np.int64)
        ranks = np.full((len(names), len(known) + 1), -1, np.int64)
        for i, x in enumerate(names):
            ranks[i, np.searchsorted(known, np.array(learned[x], np.int64))] = np.arange(len(learned[x]))
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(where)):
                raw = data.tobytes()
                langs, scores = [], []
                for i in range(hi - lo):
                    g = top(grams(raw[offs[i] : offs[i + 1]].decode()), k)
                    if not len(g) or not names:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    at = np.searchsorted(known, g)
                    at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] != g)] = len(known)
                    r = ranks[:, at]
                    d = np.where(r < 0, k, np.abs(r - np.arange(len(g)))).sum(axis=1)
                    langs.append(names[int(d.argmin())])
                    scores.append(1.0 - float(d.min()) / (k * len(g)))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, pred, score])
        release()

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0).alias("held_out")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = profiles(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out(), "text"), learned).drop("text")
