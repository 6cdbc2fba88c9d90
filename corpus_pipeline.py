"""The corpus pipeline: four stages, from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir).  All but the last return documents
with the columns they got; their decisions take effect in what they return.

Edge cases, for all stages: further columns pass through, whatever their names (the last
stage returns pieces alone); texts are worked on whole, however long; an empty table gives
an empty result.  Rows with a null or empty text are clean, hold no lines to drop and are
linked with nothing, so they stay and are packed as their closing id.  Rows with a null
doc_id are scored, come last where lines are compared, are linked with nothing and are
packed.  Rows that repeat a doc_id are scored each, share line decisions by line number
(equal copies of one row keep theirs), and leave one row in the Jaccard stage.  Ties go to
the smaller doc_id and line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagegraph.llm import common, jaccard, lines, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model finds toxic go; it learns from the labels of documents that are still there."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one word's edit of an earlier line go, and documents of which nothing is left."""
    return lines.without_repeats(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles one stays."""
    return jaccard.keep_one(docs, width=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces placed in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("best-fit packing", pack_sequences),
]

#: Byte-pair tokens can't be had in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
