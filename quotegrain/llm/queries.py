"""The dealt operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quotegrain.llm import compression, decontamination, html_content, language, lm, mixing, oracles, phrases, pii, simhash, substring_dedup, tokens, toxicity, vectors
from quotegrain.llm.common import read
from quotegrain.session import shared_dir


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op5_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_quality(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(read(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own per call, so each call does its whole work; pass one folder to keep counts."""
    cache = f"{shared_dir(spark).rstrip('/')}/quotegrain-llm/tokens-{uuid.uuid4().hex}"
    return tokens.token_counts(read(spark, sf_dir, "documents"), cache)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training order is written down, reading by reading; ``taken`` is counted from it, and rows come in the order of their first reading."""
    rows = mixing.read_in_order(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_codes(read(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_compression": op5_compression,
    "op6_toxicity": op6_toxicity,
    "op7_html_content": op7_html_content,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_language_model": op11_language_model,
    "op12_vector_codes": op12_vector_codes,
    "op13_collocations": op13_collocations,
}
ORACLES = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op10_mixing": oracles.MIXING,
    "op12_vector_codes": oracles.VECTOR_CODES,
    "op13_collocations": oracles.COLLOCATIONS,
}
