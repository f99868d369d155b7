"""The data model: recordings as DataFrames.

``samples`` is the fact table, one row for each value: episode_id, stream,
channel, row_idx (the source's row order, the only order that counts), native
(clock ticks), t (seconds), v.  ``streams`` has a row for each stream:
taxonomy, unit, scale (seconds a tick, null if the unit is unknown), regular,
certified (the clock is the producer's capture clock), ordered (row order known).
A metric's ``results`` are its subject's keys, metric, value, unit,
availability and reason: an unmet prerequisite is a reason, never a zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = "episode_id string, stream string, channel string, row_idx bigint, native bigint, t double, v double"
STREAMS = "episode_id string, stream string, taxonomy string, unit string, scale double, regular boolean, certified boolean, ordered boolean"

STREAM_KEY = ("episode_id", "stream")
CHANNEL_KEY = ("episode_id", "stream", "channel")

#: Severity and precedence orders, worst first.
STATUSES = ("critical", "warning", "good", "report_only", "not_applicable")
DECISIONS = ("blocked", "unknown", "review", "pass")


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def over(*keys: str):
    """Rows of the keys in source order."""
    return Window.partitionBy(*keys).orderBy("row_idx")


def W():
    """A channel's rows in source order."""
    return over(*CHANNEL_KEY)


def WS():
    """A stream's rows in source order."""
    return over(*STREAM_KEY)


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The reason of the first unmet prerequisite, null if all are met; the order is part of the meaning."""
    out = F.lit(None).cast("string")
    for bad, reason in reversed(cases):
        out = F.when(bad, F.lit(reason)).otherwise(out)
    return out


def results(df: DataFrame, keys: tuple[str, ...], metric: str, unit: str, value: Column, reason: Column) -> DataFrame:
    """One row for each subject; the value is null where there is a reason, or where it is not finite."""
    value = value.cast("double")
    why = F.when(reason.isNotNull(), reason).when(~F.coalesce(finite(value), F.lit(False)), F.lit("not finite"))
    return df.select(
        *keys,
        F.lit(metric).alias("metric"),
        F.when(why.isNull(), value).alias("value"),
        F.lit(unit).alias("unit"),
        F.when(why.isNull(), "computed").otherwise("not_applicable").alias("availability"),
        why.alias("reason"),
    )


def nearest_rank(c: Column, q: float) -> Column:
    """The value at place round((n - 1) * q) of the sorted values, halves to even."""
    ordered = F.sort_array(F.collect_list(c))
    return F.element_at(ordered, (F.rint((F.size(ordered) - 1) * F.lit(q)) + 1).cast("int"))
