"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, source mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the documents are written as Parquet and read again, so that rows keep their
place and a lost executor costs one stage at most. All stages but the last
return the columns of ``documents``; the last adds ``mix_level``, the smallest
nested budget that holds the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcgraph.llm import decontam, divergence, mixing, pii, simhash
from srcgraph.llm.common import fresh, materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose histograms diverge from their language go."""
    return divergence.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private parts of the texts are replaced by their labels."""
    return pii.redact(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut to their target weights."""
    return mixing.apply_mix(docs, mixing.thresholds(docs), fresh(docs, "mix_level"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mixture", source_mixture),
]

#: Near duplicates and the random field have no SQL form; the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
