"""The query of language-model scoring; SQL can't express its model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._spark import table
from .lm_score import lm_scores

#: Bytes of context.
DEPTH = 6


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), depth=DEPTH)
