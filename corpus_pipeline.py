"""The corpus pipeline: its stages, and a run of them over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anchorage.llm import stages
from anchorage.llm.common import table

STAGES = stages.STAGES

#: Near duplicates, entropy balancing and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; no documents give no rows."""
    return stages.run(spark, table(spark, sf_dir, "documents"), sf_dir)
