"""The query of chat formatting; its test is a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._spark import table
from .quotations import link_quotations


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))
