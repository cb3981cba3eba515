"""Registered queries of this subpackage: ``op<N>_<name>`` and the pipeline,
each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairnet.llm import alignment, ann, exact_dedup, langid, mixing, packing, simhash, suffix_dedup, token_count, token_files
from pairnet.llm import toxicity, variants, window_packing
from pairnet.llm.common import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """A public vocabulary file of this machine; the operators take the path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), 50) \
        .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), 2048, 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), 4096)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), 2) \
        .select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir), 4, 4).select("doc_id", "fingerprint", "component_id")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_forms(documents(spark, sf_dir))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.packed_windows(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), 1024, 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def registry() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_suffix_dedup, op2_best_fit_packing, op3_token_counts, op4_exact_dedup, op5_nearest_neighbours, op6_token_files, op7_language_id,
        op8_simhash, op9_source_mix,
        op10_toxicity, op11_spelling_variants, op12_window_packing, op13_token_alignment)}
