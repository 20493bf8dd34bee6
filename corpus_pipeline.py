"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, the table that the stage before it wrote; the
first gets `documents`. All but the last return the columns of docs. Labels are read from sf_dir and count only for
documents that are still there; the folds of the scoring queries are held out here as well.

Rows without doc_id are scored, mixed and packed like others, and are no duplicates of anything; rows of one doc_id with
equal texts are one document to the near-duplicate stage, which keeps one of them, other texts of it are their own. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.llm import mixing, neardup, packing, quality, toxicity
from alertloom.llm.queries import tokenizer_path
from alertloom.llm.texts import fold, learned_rows, small, table
from alertloom.session import durable

AT = 0.5
WORD_TABLE = 48 << 20  # bytes of a packing worker's table of words: executors still hold what the stages before needed


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list]:
    """(docs with own columns of these names renamed, expressions that give the columns of docs back)."""
    renamed = {c: f"_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(renamed), [F.col(renamed.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores is below AT."""
    labels = learned_rows(table(spark, sf_dir, "labels"), "toxic").where(fold("doc_id", 5) != 0)
    rows, own = _aside(docs, ["toxic_score", "offences"])
    return toxicity.scored(rows, toxicity.fit(docs, labels)).where(F.col("toxic_score") < AT).select(*own)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant gives AT or more."""
    labels = learned_rows(table(spark, sf_dir, "labels"), "quality").where(fold("doc_id", 3) != 1)
    known = durable(quality.with_statistics(docs.select("doc_id", "text").join(small(durable(labels)), "doc_id")))
    rows, own = _aside(docs, ["quality_score"])
    return quality.scored_texts(rows, quality.fit(known)).where(F.col("quality_score") >= AT).select(*own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one with the smallest doc_id, of one doc_id the longest text."""
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each pass over its source."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), kept_bytes=WORD_TABLE)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

#: The fitted stages cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
