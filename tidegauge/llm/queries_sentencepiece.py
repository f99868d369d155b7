"""The query of SentencePiece encoding and decoding; its test is the library itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._spark import table
from .sentencepiece_lattice import encoding_report


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
