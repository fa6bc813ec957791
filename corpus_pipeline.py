"""A corpus pipeline of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark.llm.pipeline import STAGES, run_stages

#: The stages use trained models and signatures, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet and read again."""
    return run_stages(spark, sf_dir, STAGES)
