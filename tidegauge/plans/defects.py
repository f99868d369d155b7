"""Deterministic clean recordings and the defects that can be put into them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import CHANNEL_KEY, W


def clean_recording(spark: SparkSession, rows: int = 100, hz: float = 100.0, channels: int = 3, episodes: int = 1) -> DataFrame:
    """Sines of rising harmonics; each episode is a little out of phase with the last."""
    base = spark.range(episodes * rows).select((F.col("id") / rows).cast("bigint").alias("e"), (F.col("id") % rows).alias("row_idx"))
    made = base.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(channels))))
    t = F.col("row_idx") / hz
    return made.select(F.concat(F.lit("clean"), F.col("e")).alias("episode_id"), F.lit("tcp_pose").alias("stream"), F.concat(F.lit("c"), F.col("k")).alias("channel"), "row_idx", (F.col("row_idx") * int(1e6 / hz)).alias("native"), t.alias("t"), F.sin(2 * math.pi * F.col("k") * t + F.col("e") * 0.1).alias("v"))


def clean_taxels(spark: SparkSession, rows: int = 100, cells: int = 16) -> DataFrame:
    """One load and unload, each cell a little stronger than the last."""
    made = spark.range(rows).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return made.select(F.lit("clean0").alias("episode_id"), F.lit("taxel").alias("stream"), F.concat(F.lit("c"), F.col("k")).alias("channel"), F.col("id").alias("row_idx"), (F.col("id") * 20000).alias("native"), (F.col("id") / 50).alias("t"), (F.sin(math.pi * F.col("id") / (rows - 1)) * (1 + 0.05 * F.col("k"))).alias("v"))


def _n():
    return F.count("*").over(Window.partitionBy(*CHANNEL_KEY))


def stick(s: DataFrame, start: int, length: int) -> DataFrame:
    held = F.max(F.when(F.col("row_idx") == start, F.col("v"))).over(Window.partitionBy(*CHANNEL_KEY))
    return s.withColumn("v", F.when(F.col("row_idx").between(start, start + length - 1), held).otherwise(F.col("v")))


def drop(s: DataFrame, start: int, length: int) -> DataFrame:
    return s.where(~F.col("row_idx").between(start, start + length - 1))


def repeat_timestamps(s: DataFrame) -> DataFrame:
    odd = (F.col("row_idx") % 2 == 1) & F.lag("native").over(W()).isNotNull()
    return s.withColumns({"native": F.when(odd, F.lag("native").over(W())).otherwise(F.col("native")), "t": F.when(odd, F.lag("t").over(W())).otherwise(F.col("t"))})


def jitter(s: DataFrame, ticks: int) -> DataFrame:
    move = F.when(F.col("row_idx") % 2 == 0, ticks).otherwise(-ticks)
    return s.withColumns({"native": F.col("native") + move, "t": F.col("t") + move / 1e6})


def null_run(s: DataFrame, start: int, length: int) -> DataFrame:
    return s.withColumn("v", F.when(~F.col("row_idx").between(start, start + length - 1), F.col("v")))


def stretch(s: DataFrame, growth: float) -> DataFrame:
    """Gaps that grow evenly, added up."""
    extra = growth * F.col("row_idx") * (F.col("row_idx") + 1) / 2
    return s.withColumns({"native": (F.col("native") + extra * 1e6).cast("bigint"), "t": F.col("t") + extra})


def saturate(s: DataFrame, low: float, high: float) -> DataFrame:
    return s.withColumn("v", F.least(F.greatest("v", F.lit(low)), F.lit(high)))


def ramp(s: DataFrame, step: float) -> DataFrame:
    return s.withColumn("v", F.col("v") + step * F.col("row_idx"))


def spike(s: DataFrame, deviations: float = 20.0) -> DataFrame:
    std = F.stddev_pop("v").over(Window.partitionBy(*CHANNEL_KEY))
    return s.withColumn("v", F.when(F.col("row_idx") == F.floor(_n() / 2), F.col("v") + deviations * std).otherwise(F.col("v")))


def step(s: DataFrame, at: int, size: float) -> DataFrame:
    return s.withColumn("v", F.when(F.col("row_idx") >= at, F.col("v") + size).otherwise(F.col("v")))


def noise(s: DataFrame, size: float) -> DataFrame:
    return s.withColumn("v", F.col("v") + F.when(F.col("row_idx") % 2 == 0, size).otherwise(-size))


def kill_taxels(s: DataFrame, cells: int) -> DataFrame:
    return s.withColumn("v", F.when(F.regexp_extract("channel", r"(\d+)$", 1).cast("int") < cells, 0.0).otherwise(F.col("v")))


def skew_unloading(s: DataFrame, share: float) -> DataFrame:
    return s.withColumn("v", F.when(F.col("row_idx") >= F.floor(_n() / 2), F.col("v") * (1 - share)).otherwise(F.col("v")))


#: defect: (transform, the metric that has to see it)
DEFECTS = {
    "stuck": (lambda s: stick(s, 20, 60), "flatline_pct"),
    "dropped": (lambda s: drop(s, 40, 20), "recorded_drop_estimate"),
    "repeated_timestamps": (repeat_timestamps, "monotonic_violations"),
    "jitter": (lambda s: jitter(s, 4000), "recorded_dt_spread_ms"),
    "nulls": (lambda s: null_run(s, 30, 20), "missing_pct"),
    "stretched": (lambda s: stretch(s, 1e-4), "recorded_dt_spread_ms"),
    "saturated": (lambda s: saturate(s, -0.5, 0.5), "limit_proximity_pct"),
    "drift": (lambda s: ramp(s, 0.05), "drift"),
    "spike": (spike, "spike_pct"),
    "step": (lambda s: step(s, 50, 5.0), "velocity_spike_pct"),
    "noise": (lambda s: noise(s, 0.5), "snr_db"),
}


def variants(samples: DataFrame) -> DataFrame:
    """The recording with each defect, episodes named by it."""
    out = samples
    for name, (change, _) in DEFECTS.items():
        out = out.unionByName(change(samples).withColumn("episode_id", F.concat_ws("+", "episode_id", F.lit(name))))
    return out


def streams_of(samples: DataFrame) -> DataFrame:
    """Streams of made recordings: regular, in microseconds, with a capture clock."""
    yes = F.lit(True)
    return samples.select("episode_id", "stream").distinct().select("*", F.lit("proprio.joint_position").alias("taxonomy"), F.lit("us").alias("unit"), F.lit(1e-6).alias("scale"), yes.alias("regular"), yes.alias("certified"), yes.alias("ordered"))


def detection(samples: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """defect, metric, clean and defective value (means over subjects): what each metric makes of each defect."""
    from ..operators.registry import METRICS

    every = variants(samples)
    streams = streams_of(every)
    parts = None
    for name in metrics:
        r = METRICS[name].run(every, streams).select("episode_id", "metric", "value")
        parts = r if parts is None else parts.unionByName(r)
    split = F.split("episode_id", r"\+")
    found = parts.groupBy(F.coalesce(F.get(split, F.lit(1)), F.lit("clean")).alias("defect"), "metric").agg(F.avg("value").alias("value"))
    clean = found.where("defect = 'clean'").select("metric", F.col("value").alias("clean"))
    return found.where("defect <> 'clean'").join(clean, "metric", "left").select("defect", "metric", "clean", "value")
