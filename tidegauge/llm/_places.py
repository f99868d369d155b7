"""Rows with places in their texts: keys, joins and grouping shared by the operators on repeated passages.

A row is known by its id and a hash of its text, so that rows that repeat an
id keep their own places, and rows equal in both are equal in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import written

KEY = ("doc_id", "rk")


def packed(carry: tuple[str, ...]) -> list:
    """Columns to carry along, as one struct ``row``: their names can clash with nothing."""
    return [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.hash(text).alias("rk"), text.alias("text"), *packed(carry))


def with_places(docs: DataFrame, places: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """Keyed docs with the places of their key, null where there are none (how: left) or only those that have some (inner)."""
    p = places.select(F.col("doc_id").alias("p_id"), F.col("rk").alias("p_rk"), *columns)
    return docs.join(p, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("rk") == F.col("p_rk")), how).select(*docs.columns, *columns)


def repeated(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """The rows whose keys at least so many rows hold.

    Counts are partial sums before the shuffle.  They are a table of their own,
    so that both sides of the join have a plain exchange and Spark can split a
    key held by very many rows.
    """
    often = written(rows.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") >= least), "often")
    return rows.join(often, keys)


def by_row(places: DataFrame, *columns: str) -> DataFrame:
    """One row for each key with the sorted lists of its places: as many as the text has at most."""
    return places.groupBy(*KEY).agg(*[F.collect_list(c).alias(c) for c in columns])
