"""Timing: gaps between adjacent ticks, in source order, and what follows from them.

A gap stands only between rows that are both finite; a null breaks it, it isn't
bridged.  Ticks are subtracted before they are scaled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import STREAM_KEY, WS, first_reason, results
from .registry import metric


def clock_rows(samples: DataFrame) -> DataFrame:
    """One row for each stream row: the clock doesn't depend on the channel."""
    return samples.groupBy(*STREAM_KEY, "row_idx").agg(F.first("native").alias("native"))


def adjacent_gaps(samples: DataFrame, streams: DataFrame) -> DataFrame:
    """Stream rows with gap (seconds) to the row before, null where there is none."""
    scale = streams.select(*STREAM_KEY, "scale")
    rows = clock_rows(samples).join(scale, list(STREAM_KEY))
    return rows.withColumn("gap", (F.col("native") - F.lag("native").over(WS())) * F.col("scale"))


def cadence(samples: DataFrame, streams: DataFrame) -> DataFrame:
    """Per stream: rows, invalid rows, gaps, non-positive gaps, median gap, spread (ms), span."""
    stats = adjacent_gaps(samples, streams).groupBy(*STREAM_KEY).agg(
        F.count("*").alias("n"),
        F.sum(F.col("native").isNull().cast("int")).alias("invalid"),
        F.count("gap").alias("gaps"),
        F.sum((F.col("gap") <= 0).cast("int")).alias("bad"),
        F.median("gap").alias("median"),
        (F.stddev_samp("gap") * 1000).alias("spread"),
        F.sum("gap").alias("span"),
    )
    return streams.select(*STREAM_KEY, "scale", "regular", "certified", "ordered").join(stats, list(STREAM_KEY), "left").fillna({"n": 0, "invalid": 0, "gaps": 0})


def _reason(least: int, certified: bool):
    capture = [(~F.col("certified"), "not a certified capture clock")] if certified else []
    return first_reason(
        (~F.col("ordered"), "source row order unavailable"),
        *capture,
        (F.col("scale").isNull(), "time unit unknown"),
        (F.col("invalid") > 0, "invalid timestamps"),
        (F.col("n") < least, "too few samples"),
        (F.col("bad") > 0, "non-positive gaps"),
        (~F.col("regular"), "not regular"),
    )


def _drop():
    expected = F.col("span") / F.col("median") + 1
    return F.greatest(F.lit(0.0), (expected - F.col("n")) / expected)


@metric("effective_hz", level="stream", family="timing", unit="Hz")
def effective_hz(samples: DataFrame, streams: DataFrame) -> DataFrame:
    return results(cadence(samples, streams), STREAM_KEY, "effective_hz", "Hz", 1 / F.col("median"), _reason(2, True))


@metric("dt_jitter_ms", level="stream", family="timing", unit="ms")
def dt_jitter_ms(samples: DataFrame, streams: DataFrame) -> DataFrame:
    return results(cadence(samples, streams), STREAM_KEY, "dt_jitter_ms", "ms", F.col("spread"), _reason(5, True))


@metric("drop_rate", level="stream", family="timing", unit="fraction")
def drop_rate(samples: DataFrame, streams: DataFrame) -> DataFrame:
    return results(cadence(samples, streams), STREAM_KEY, "drop_rate", "fraction", _drop(), _reason(2, True))


@metric("recorded_hz", level="stream", family="timing", unit="Hz")
def recorded_hz(samples: DataFrame, streams: DataFrame) -> DataFrame:
    return results(cadence(samples, streams), STREAM_KEY, "recorded_hz", "Hz", 1 / F.col("median"), _reason(2, False))


@metric("recorded_dt_spread_ms", level="stream", family="timing", unit="ms")
def recorded_dt_spread_ms(samples: DataFrame, streams: DataFrame) -> DataFrame:
    return results(cadence(samples, streams), STREAM_KEY, "recorded_dt_spread_ms", "ms", F.col("spread"), _reason(5, False))


@metric("recorded_drop_estimate", level="stream", family="timing", unit="fraction")
def recorded_drop_estimate(samples: DataFrame, streams: DataFrame) -> DataFrame:
    return results(cadence(samples, streams), STREAM_KEY, "recorded_drop_estimate", "fraction", _drop(), _reason(2, False))


@metric("monotonic_violations", level="stream", family="timing", unit="count")
def monotonic_violations(samples: DataFrame, streams: DataFrame) -> DataFrame:
    """Repeated and backward ticks; regularity isn't needed."""
    why = first_reason((~F.col("ordered"), "source row order unavailable"), (F.col("scale").isNull(), "time unit unknown"), (F.col("gaps") < 1, "no adjacent timestamps"))
    return results(cadence(samples, streams), STREAM_KEY, "monotonic_violations", "count", F.coalesce("bad", F.lit(0)), why)


def violation_rows(samples: DataFrame, streams: DataFrame, most: int = 100) -> DataFrame:
    """The evidence: the first rows whose gap isn't positive, at most so many a stream; rows that share a number are all there, in order of their ticks."""
    again = F.row_number().over(Window.partitionBy(*STREAM_KEY, "channel", "row_idx").orderBy("native"))
    rows = samples.withColumn("_again", again).groupBy(*STREAM_KEY, "row_idx", "_again").agg(F.first("native").alias("native"))
    w = Window.partitionBy(*STREAM_KEY).orderBy("row_idx", "_again")
    gap = (F.col("native") - F.lag("native").over(w)) * F.col("scale")
    bad = rows.join(streams.select(*STREAM_KEY, "scale"), list(STREAM_KEY)).withColumn("gap", gap).where("gap <= 0").withColumn("place", F.row_number().over(w))
    return bad.where(F.col("place") <= most).select(*STREAM_KEY, "row_idx", F.when(F.col("gap") == 0, "repeated").otherwise("backwards").alias("kind"))


def regularity(samples: DataFrame, streams: DataFrame, share: float = 0.8, tolerance: float = 0.3) -> DataFrame:
    """Per stream: median gap, the share of gaps near it, and whether that makes the stream regular."""
    gaps = adjacent_gaps(samples, streams).where("gap IS NOT NULL")
    middle = gaps.groupBy(*STREAM_KEY).agg(F.median("gap").alias("median"))
    near = (F.abs(F.col("gap") - F.col("median")) <= tolerance * F.col("median")).cast("double")
    out = gaps.join(middle, list(STREAM_KEY)).groupBy(*STREAM_KEY).agg(F.first("median").alias("median_gap"), F.avg(near).alias("near_share"))
    return out.withColumn("regular", (F.col("median_gap") > 0) & (F.col("near_share") >= share))
