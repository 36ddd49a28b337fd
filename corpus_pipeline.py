"""The training-data pipeline: stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillgrid.llm import stages
from rillgrid.llm.tables import read, stage

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("pii", stages.pii),
    ("mixing", stages.mixing),
]
#: SQL can't express the histograms' distance from references, min-max hashing and string tiling;
#: tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
