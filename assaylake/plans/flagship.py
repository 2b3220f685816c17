"""Flagship query used by ``__spark_entry__.entry``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .q_ml import potency_score
from .registry import load_all


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_all()
    return potency_score(spark, sf_dir)
