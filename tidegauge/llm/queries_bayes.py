"""The query of the quality classifier; its tests are held-out accuracy and a plain computation of its posteriors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from .bayes_quality import hierarchical_quality


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source; its path there is its language."""
    return hierarchical_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
