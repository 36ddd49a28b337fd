"""The pipeline's stages: each takes (spark, docs, sf_dir) and returns documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, near, quality
from . import mixing as mixer
from . import pii as privacy
from .tables import read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies; those without a word have no copies and stay."""
    return near.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the new text."""
    return privacy.replace_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with the number of words taken."""
    return mixer.choose(docs)
