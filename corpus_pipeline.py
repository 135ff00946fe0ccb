"""Corpus pipeline: quality rules, language, exact and near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import stages
from strandline.llm.common import materialise, table

STAGES = [
    ("quality rules", stages.quality_stage),
    ("language ID", stages.language_stage),
    ("exact dedup", stages.exact_stage),
    ("near-dedup", stages.near_stage),
    ("packing", stages.packing_stage),
]

#: Mixtures, components and packing have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
