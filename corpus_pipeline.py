"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing and
packing, each stage over all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``. Those
with Python tasks set the session's Arrow batches (``small_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairnet.llm import exact_dedup, langid, mixing, packing, simhash
from pairnet.llm.common import documents, small_batches
from pairnet.llm.queries import tokenizer
from pairnet.session import checkpoint


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language; those without one (``und``: no
    letter in the text) go. A table without labels keeps the same rows."""
    small_batches(spark)
    return langid.with_language(docs, langid.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts, the one with the largest id."""
    small_batches(spark)
    return exact_dedup.kept_documents(docs, exact_dedup.exact_groups(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component, the one with the smallest id."""
    small_batches(spark)
    return simhash.representatives(docs, simhash.near_groups(docs, 4, 4))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights; rows repeat as often as taken."""
    return mixing.mixed(docs, mixing.plan(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.packed_documents(docs, tokenizer("byte_bpe_50k.json"), 2048, 0)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
