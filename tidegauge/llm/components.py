"""Connected components over a table of links, never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import removed, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another; the component is its least node.

    Large-star and small-star steps in turn (Kiveris et al., 2014) on links
    (u, v) with u > v.  ``low`` is the least of each u's lower neighbours; a node
    without lower neighbours is its own.  The large star hangs every u on its v's
    low, the small star on the least of what that leaves.  The low of a node is
    a table of its own, so that Spark can split the rows of a v with very many
    links: they stand against one row, or, where all hang on a root, none.
    Null links are left out; repeated ones count once.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    edges = written(edges, "links")
    while True:
        low = written(edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")), "low")
        known = low.select(F.col("u").alias("v"), "low")
        if low.where("n > 1").isEmpty() and edges.join(known, "v", "left_semi").isEmpty():
            removed(low)
            roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        large = edges.join(known, "v", "left").select("u", F.coalesce("low", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        removed(low)
        removed(edges)
        edges = new
