"""Row numbers of a whole order without one task that holds it: ranges of the order are counted, then numbered each by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least and greatest number of ranges of an order, rows of a range in all, and rows of a task.
RANGES, MOST, ROWS, TASK = 64, 256, 1 << 20, 1 << 16


def bounds(df: DataFrame, order: str) -> list:
    """Values that part an order into about equal ranges: of those whose hash is of one class in so many, evenly spaced ones.  Any bounds give the same numbers; no ranges but of numbers and text."""
    if not isinstance(df.schema[order].dataType, (T.NumericType, T.StringType)):
        return []
    n = df.count()
    few, ranges = max(1, n // 8192), min(MOST, max(RANGES, n // ROWS))
    found = [r[0] for r in df.select(order).where(F.col(order).isNotNull() & (F.pmod(F.xxhash64(order), F.lit(few)) == 0)).distinct().orderBy(order).collect()]
    return [found[i] for i in sorted({i * len(found) // ranges for i in range(1, ranges)} - {0})]


def range_of(x: Column, cuts: list, kind: T.DataType) -> Column:
    """The number of bounds at or below a value, found by halves; nulls, which sort first, are in range 0."""

    def within(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(x < F.lit(cuts[m]).cast(kind), within(a, m)).otherwise(within(m + 1, b))

    return F.when(x.isNull(), F.lit(0)).otherwise(within(0, len(cuts)))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds a row's place in the order of its keys, from 0, and chunk, the range of the order that it is in."""
    kind = df.schema[order[0]].dataType
    rows = df.withColumn("chunk", range_of(F.col(order[0]), bounds(df, order[0]), kind))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // TASK)
    past = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "chunk").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    before = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("chunk").alias("_chunk"), "_before")
    on = F.col("chunk") == F.col("_chunk")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy(*order)) - 1
    placed = rows.repartition(tasks, *keys, "chunk").withColumn(name, inner.cast("bigint")).join(F.broadcast(before), on)
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_before", "_chunk", *[f"_k{i}" for i in range(len(keys))])
