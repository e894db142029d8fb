"""From documents to packed training sequences: each stage works on all that its predecessor kept.

All but the last stage return the columns of documents, whatever they are named: helper columns never meet them, as rows
pass through a stage under names of its own. A document with null text counts as an empty one; the quality stage scores
it like any other, the language stage rejects it. The quality stage learns from `labels` by id, the language stage from
the lang column of the documents that reach it; neither takes a document's id, language or source as an input.

Null ids are ids that no other row shares with them: such rows are copies by their text alone, and stay in the near
stage. Rows that repeat an id are judged each by its own text. Of rows with one id and one text one stays, the least by a
hash of its columns; of equal texts the smallest id stays, of a group of near copies too. An empty table passes through
all stages. A very long text is one row of work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import dedup, jaccard, language, packing, quality
from tidemark.llm.common import stored, table

#: Documents whose best profile is farther than this, as one minus the share of the largest distance, are in no known language.
LEAST_LANGUAGE_SCORE = 0.2
#: Text bytes that the last stage handles in one step: its workers share executors with what the other stages left in memory.
PACKING_CHUNK = 1 << 19


def _aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with its columns named _0, _1 ..., but for text and doc_id; and the columns that bring their names back."""
    own = {c: c if c in ("doc_id", "text") else f"_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), [F.col(new).alias(old) for old, new in own.items()]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows, back = _aside(docs)
    return quality.classify(rows, model, score="score", predicted="predicted").where("predicted = 1").select(back)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = language.profiles(docs)
    rows, back = _aside(docs)
    found = language.identify(rows, learned, pred="pred", score="score")
    return found.where((F.col("pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(back)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(docs, once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id, stays."""
    copies = jaccard.near_duplicates(docs.select("doc_id", "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("copy")).distinct()
    rows, back = _aside(docs)
    return rows.join(copies, F.col("doc_id") == F.col("copy"), "left_anti").select(back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"), chunk=PACKING_CHUNK)


STAGES = [("quality", keep_quality), ("language", keep_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]
#: The classifier and the packing aren't expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
