"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, extraction, language_model, licences, mixing, near, pii, quality, sql, substring, suffixes
from .tables import read


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(read(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.dedup(read(spark, sf_dir, "documents"), k=2)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(read(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(read(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_suffix_array_dedup, op3_decontamination, op4_minhash_dedup, op5_html_extraction, op6_license_scan, op7_pii_surrogates, op8_source_mix, op9_lm_scores, op10_quality_rules)
}
#: Where SQL can't express an operator or takes too long on whole tables, tests hold it against brute force.
SQL: dict[str, str] = {"op1_substring_dedup": sql.SUBSTRING, "op2_suffix_array_dedup": sql.SUFFIXES, "op4_minhash_dedup": sql.NEAR, "op8_source_mix": sql.MIX}
