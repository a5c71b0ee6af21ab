"""From raw documents to token digests: language ID, line dedup, near-duplicate removal, source mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import language, line_templates, mixing, ngram_join, pieces
from gridloom.llm.common import documents, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on them, accepts; texts without a letter or of no clear language go."""
    return language.accepted(spark, docs)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines of templates that recur across documents."""
    return line_templates.deduped(spark, docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one of the smallest doc_id."""
    return ngram_join.one_of_each(spark, docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    return mixing.drawn(spark, docs)


def encoded_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's pieces and of their decoded text."""
    return pieces.digests(docs)


STAGES = [
    ("language", known_language),
    ("lines", without_recurring_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("mixing", mixed_sources),
    ("pieces", encoded_pieces),
]
#: The language model, the template tree and the piece encoder have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each on the written result of the one before."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(spark, docs, name)
    return docs
