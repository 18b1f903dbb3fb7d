"""A corpus pipeline: quality rules, near-duplicates, repeated passages, mixing and encoding, one after another.

Every stage reads all rows that the one before it kept. The first four return the columns of ``documents``; the last one
returns the ids of each row the mix has (a document taken twice is there twice). Missing or empty tables of rows give
empty results; each operator's module says what nulls, empty and very long texts, ties and repeated rows give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, mixing, quality_rules, simhash, substring_dedup
from quern.scratch import dropped, scope, written
from quern.session import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.quality_filter(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts (five-word shingles, similarity 0.8)."""
    return simhash.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` of each row."""
    return bpe.encoded_rows(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: BPE has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table and read again; a stage's tables, and those of the stage before
    it, go when it ends."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = docs
        with scope() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        if i:
            dropped(before)
    return docs
