"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm._spark import scratch, table
from tidegauge.llm.decontaminate import without_leaks
from tidegauge.llm.near_dedup import without_near_duplicates
from tidegauge.llm.quality import DEFAULT, apply_policy, quality_ledger
from tidegauge.llm.sentencepiece_lattice import encode
from tidegauge.llm.substring_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the policy rejects go."""
    kept = apply_policy(quality_ledger(docs, carry=tuple(docs.columns)), DEFAULT)
    return kept.where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of least id; rows are told apart by id and text."""
    return without_near_duplicates(docs, words=5, percent=80)


def _with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The carried columns with a new text and its length."""
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("bigint")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in columns])


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "text")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that occur twice go; texts without any stay as they are."""
    rows = remove_repeats(docs, window=50, carry=_others(docs))
    rows = rows.withColumn("new", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return _with_text(rows, docs.columns, "new")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items or more go; from others the words of such windows go."""
    rows = without_leaks(docs, table(spark, sf_dir, "benchmark"), most=1, carry=_others(docs))
    return _with_text(rows, docs.columns, "text")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document."""
    return encode(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: The last stage's ids are not to be had in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
