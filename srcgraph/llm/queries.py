"""One query an operator, over its whole intended table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from srcgraph.llm import bwt, decontam, divergence, lm, mixing, pii, rules, simhash, toxicity, url_lm
from srcgraph.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private(table(spark, sf_dir, "documents"))


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(table(spark, sf_dir, "documents"))


def op3_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.classify(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.WEIGHTS, default_weight=mixing.DEFAULT_WEIGHT)


def op5_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.repeats(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_pii, op2_divergence, op3_url_ratio, op4_mixing, op5_bwt_repeats, op6_simhash, op7_toxicity, op8_rules, op9_context_mixing, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op2_divergence": divergence.oracle_sql(), "op4_mixing": mixing.oracle_sql(weights=mixing.WEIGHTS, default_weight=mixing.DEFAULT_WEIGHT)}
