"""The registered query of each operator, at production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import contamination, language, licenses, mixing, neardup, passages, preference, quality, urls, webtext
from .common import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), corpus_pipeline.WEIGHTS)


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.deduplicated(table(spark, sf_dir, "documents"), digest=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "rule string, verdict string")
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.formatted(preference.pairs_of(table(spark, sf_dir, "conversations")))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_webtext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.main_text(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mix, op2_neardup, op3_language, op4_passages, op5_quality, op6_urls, op7_preference, op8_contamination, op9_licenses, op10_webtext, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": mixing.ORACLE, "op6_urls": urls.ORACLE, "op7_preference": preference.ORACLE}
