"""A training corpus from raw documents: five stages, each one operator of ``quotegrain.llm``.

1. toxicity: documents that the model rejects go.
2. near_duplicates: one document of each group of near copies (Jaccard 0.8 or more on five-word shingles) stays, the one with the smallest doc_id.
3. decontamination: documents that leak a benchmark item go.
4. personal_data: spans of personal data are replaced by their kind.
5. mixing: documents are taken and put in order by the curriculum; one row per reading.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``, whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotegrain.llm import decontamination, mixing, pii, shingles, toxicity
from quotegrain.llm.common import read, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", redact),
    ("mixing", mix),
]

#: The learned stages and XXH64 have no SQL form; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
