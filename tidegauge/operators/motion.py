"""Motion: jerk, chatter, saturation, vibration, torque and energy.

Two idioms of nulls are kept apart: jerk, chatter and drift at rest drop nulls
and bridge them; velocity spikes don't.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CHANNEL_KEY, STREAM_KEY, W, finite, first_reason, nearest_rank, results
from .parts import PART_KEY, among, by_parts, over, parted, variance, with_mean, with_median
from .registry import Requires, metric

# The taxonomies these metrics are of.
JOINT_POSITION = "proprio.joint_position"
JOINT_VELOCITY = "proprio.joint_velocity"
JOINT_TORQUE = "proprio.joint_torque"


def _median_step(samples: DataFrame) -> DataFrame:
    steps = samples.select(*CHANNEL_KEY, (F.col("t") - F.lag("t").over(W())).alias("step"))
    return steps.groupBy(*STREAM_KEY).agg(F.median("step").alias("dt"))


def _thirds(samples: DataFrame) -> DataFrame:
    """Per channel: rows, those not finite, range and deviation, third differences over nulls (number, squares, greatest), and the stream's median step."""

    def values(w):
        v, a, b, c = F.col("v"), *[F.expr(f"lag(v, {k}) IGNORE NULLS {w}") for k in (1, 2, 3)]
        # a row without a value has no third difference, so it is ready
        return {"step": (F.col("t") - F.expr(f"lag(t) {w}"), among(-1, w)), "d3": (F.when(v.isNotNull(), v - 3 * a + 3 * b - c), v.isNull() | c.isNotNull())}

    def edge(w):
        near = F.expr(f"lag(v, 3) IGNORE NULLS {w}").isNull() | F.expr(f"lead(v, 3) IGNORE NULLS {w}").isNull()
        return (F.col("v").isNotNull() & near) | ~among(-5, w) | ~among(1, w)

    d3 = F.col("d3")
    merged = {
        "n_": ("sum", F.lit(1)),
        "bad_": ("sum", (~F.coalesce(finite(F.col("v")), F.lit(False))).cast("int")),
        "steps": ("sum", F.col("step").isNotNull().cast("int")),
        "thirds": ("sum", d3.isNotNull().cast("int")),
        "squares": ("sum", d3 * d3),
        "top": ("max", F.abs(d3)),
    }
    rows = with_median(with_mean(by_parts(samples, values, edge, merged, by="step", moments=("v",)), "v"), STREAM_KEY, "step", "steps", "dt")
    each = rows.groupBy(*CHANNEL_KEY).agg(
        F.sum("n_").alias("n"),
        F.sum("bad_").alias("bad"),
        F.max("dt_lo").alias("lo"),
        F.max("dt_hi").alias("hi"),
        F.sum("thirds").alias("thirds"),
        F.sum("squares").alias("squares"),
        F.max("top").alias("top"),
        (F.max("max_v") - F.min("min_v")).alias("range"),
        F.sqrt(variance("v", False)).alias("spread"),
        F.slice(F.sort_array(F.collect_set(F.when(F.col("_end"), F.col("row_idx")))), 1, 5).alias("first_rows"),
    )
    stream = Window.partitionBy(*STREAM_KEY)
    return each.withColumn("dt", (F.max("lo").over(stream) + F.max("hi").over(stream)) / 2)


def _jerk(samples: DataFrame, streams: DataFrame, name: str, value) -> DataFrame:
    """Third differences over the channel's deviation and the cube of the median step, pooled over a stream; value: of the sum of their squares, their number and their greatest."""
    moves = (F.col("spread") > 0) & (F.col("dt") > 0) & (F.col("thirds") > 0)
    unit = F.col("spread") * F.col("dt") ** 3
    squares, number = F.sum(F.when(moves, F.col("squares") / unit / unit)), F.sum(F.when(moves, F.col("thirds")))
    greatest = F.max(F.when(moves, F.col("top") / F.col("spread") / F.col("dt") ** 3))
    n = F.when(F.max("n") >= 5, F.max("n")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("first_rows")))))
    pooled = _thirds(samples).groupBy(*STREAM_KEY).agg(n.alias("n"), value(squares, number, greatest).alias("jerk"))
    stats = pooled.join(streams.select(*STREAM_KEY, "regular"), list(STREAM_KEY))
    why = first_reason((~F.col("regular"), "not regular"), (F.col("n") < 5, "too few samples"), (F.col("jerk").isNull(), "no moving channel"))
    return results(stats, STREAM_KEY, name, "normalised", F.col("jerk"), why)


@metric("mean_jerk_norm", level="stream", family="motion", unit="normalised", requires=Requires((JOINT_POSITION,), 5, True))
def mean_jerk_norm(samples: DataFrame, streams: DataFrame) -> DataFrame:
    return _jerk(samples, streams, "mean_jerk_norm", lambda squares, number, greatest: F.sqrt(squares / number))


@metric("max_abs_jerk", level="stream", family="motion", unit="normalised", requires=Requires((JOINT_POSITION,), 5, True))
def max_abs_jerk(samples: DataFrame, streams: DataFrame) -> DataFrame:
    return _jerk(samples, streams, "max_abs_jerk", lambda squares, number, greatest: greatest)


@metric("velocity_spike_pct", level="channel", family="motion", unit="%", requires=Requires((JOINT_POSITION,), 40, True))
def velocity_spike_pct(samples: DataFrame, streams: DataFrame) -> DataFrame:
    """First differences of adjacent finite rows over six population deviations from their mean."""
    d = F.when(finite(F.col("v")) & finite(F.lag("v").over(W())), F.col("v") - F.lag("v").over(W()))
    rows = samples.withColumn("d", d)
    spread = rows.groupBy(*CHANNEL_KEY).agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.count("*").alias("n"))
    out = (F.abs(F.col("d") - F.col("mean")) > 6 * F.col("std")).cast("int")
    stats = rows.join(spread, list(CHANNEL_KEY)).groupBy(*CHANNEL_KEY, "n", "std").agg(F.count("d").alias("steps"), F.sum(out).alias("out"))
    stats = stats.join(streams.select(*STREAM_KEY, "regular"), list(STREAM_KEY))
    why = first_reason((~F.col("regular"), "not regular"), (F.col("n") < 40, "too few samples"), (F.coalesce("std", F.lit(0.0)) <= 0, "no variation"))
    return results(stats, CHANNEL_KEY, "velocity_spike_pct", "%", 100.0 * F.coalesce("out", F.lit(0)) / F.col("steps"), why)


@metric("log_dimensionless_jerk", level="channel", family="motion", unit="", requires=Requires((JOINT_POSITION,), 5, True))
def log_dimensionless_jerk(samples: DataFrame, streams: DataFrame) -> DataFrame:
    """-ln(T**5 * sum((d3 / dt**3)**2) * dt / range**2); all values have to be finite."""
    stats = _thirds(samples).withColumn("squares", F.when(F.col("dt") != 0, F.col("squares") / F.col("dt") ** 6))
    duration = (F.col("n") - 1) * F.col("dt")
    cost = duration**5 * F.col("squares") * F.col("dt") / F.nullif(F.col("range"), F.lit(0.0)) ** 2
    stats = stats.join(streams.select(*STREAM_KEY, "regular"), list(STREAM_KEY))
    why = first_reason((~F.col("regular"), "not regular"), (F.col("n") < 5, "too few samples"), (F.col("bad") > 0, "values not finite"), (F.col("range") <= 0, "no range"), (~(cost > 0), "no jerk"))
    return results(stats, CHANNEL_KEY, "log_dimensionless_jerk", "", -F.log(cost), why)


@metric("action_chatter", level="stream", family="motion", unit="normalised", requires=Requires((JOINT_VELOCITY,), 5, True))
def action_chatter(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Mean over channels of mean |step| over deviation; nulls are dropped first."""
    rows = samples.where("v IS NOT NULL")
    steps = rows.withColumn("d", F.abs(F.col("v") - F.lag("v").over(W())))
    each = steps.groupBy(*CHANNEL_KEY).agg(F.avg("d").alias("d"), F.stddev_pop("v").alias("std"))
    stats = each.groupBy(*STREAM_KEY).agg(F.avg(F.when(F.col("std") > 0, F.col("d") / F.col("std"))).alias("value"))
    return results(stats, STREAM_KEY, "action_chatter", "normalised", F.col("value"), first_reason((F.col("value").isNull(), "no moving channel")))


@metric("still_drift", level="stream", family="motion", unit="unit", requires=Requires((JOINT_POSITION,), 8))
def still_drift(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """How far the last fifth moves, if its steps are small beside the whole's."""
    rows = parted(samples).where("v IS NOT NULL")
    size = rows.groupBy(*PART_KEY).agg(F.count("*").alias("_c"))
    key = Window.partitionBy(*CHANNEL_KEY)
    past = key.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumns({"_n": F.sum("_c").over(key), "_past": F.coalesce(F.sum("_c").over(past), F.lit(0))}).drop("_c")
    rows = rows.join(F.broadcast(size), list(PART_KEY)).withColumn("back", F.col("_n") - F.col("_past") - F.expr(f"row_number() {over(*PART_KEY)}") + 1)
    tail = F.greatest(F.lit(5), F.rint(0.2 * F.col("_n")))
    rows = rows.withColumns({"_tail": F.col("back") < tail, "_starts": (F.col("back") == tail) | ((F.col("back") == F.col("_n")) & (F.col("_n") < tail))})
    merged = {
        "n_": ("sum", F.lit(1)),
        "steps": ("sum", F.col("step").isNotNull().cast("int")),
        "tail_steps": ("sum", (F.col("step").isNotNull() & F.col("_tail")).cast("int")),
    }
    edges = lambda w: ~among(-1, w) | ~among(1, w) | (F.col("back") == tail)
    rows = by_parts(rows, lambda w: {"step": (F.abs(F.col("v") - F.expr(f"lag(v) {w}")), among(-1, w))}, edges, merged, by="step", carry=("_tail", "back", "_starts"))
    # a value's parts are added up before any sort
    rows = rows.groupBy(*CHANNEL_KEY, "step").agg(F.sum("n_").alias("n_"), F.sum("steps").alias("steps"), F.sum("tail_steps").alias("tail_steps"), F.max(F.when(F.col("back") == 1, F.col("v"))).alias("_last"), F.max(F.when(F.col("_starts"), F.col("v"))).alias("_first"))
    rows = with_median(with_median(rows, CHANNEL_KEY, "step", "steps", "all"), CHANNEL_KEY, "step", "tail_steps", "tail")
    each = rows.groupBy(*CHANNEL_KEY).agg(
        F.sum("n_").alias("n"),
        ((F.max("tail_lo") + F.max("tail_hi")) / 2).alias("tail_step"),
        ((F.max("all_lo") + F.max("all_hi")) / 2).alias("step"),
        F.abs(F.max("_last") - F.max("_first")).alias("moved"),
    )
    still = F.when(F.col("step") > 0, F.col("tail_step") / F.col("step") <= 0.05).otherwise(F.lit(False))
    stats = each.groupBy(*STREAM_KEY).agg(F.max("n").alias("n"), F.bool_and(F.coalesce(still, F.lit(False))).alias("still"), F.max("moved").alias("moved"))
    why = first_reason((F.col("n") < 5, "too few samples"), (~F.col("still"), "the tail is not still"))
    return results(stats, STREAM_KEY, "still_drift", "unit", F.col("moved"), why)


@metric("vel_saturation_pct", level="channel", family="motion", unit="%", requires=Requires((JOINT_VELOCITY,), 2))
def vel_saturation_pct(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Share of |v| at 0.9 of its greatest or more."""
    ok = samples.where(finite(F.col("v")))
    top = ok.groupBy(*CHANNEL_KEY).agg(F.max(F.abs("v")).alias("top"))
    stats = ok.join(top, list(CHANNEL_KEY)).groupBy(*CHANNEL_KEY, "top").agg((100 * F.avg((F.abs("v") >= 0.9 * F.col("top")).cast("double"))).alias("value"))
    return results(stats, CHANNEL_KEY, "vel_saturation_pct", "%", F.col("value"), first_reason((F.col("top") <= 0, "no motion")))


@metric("limit_proximity_pct", level="channel", family="motion", unit="%", requires=Requires((JOINT_POSITION,), 2))
def limit_proximity_pct(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Share at 0.95 of the half range from the middle or more."""
    ok = samples.where(finite(F.col("v")))
    ends = ok.groupBy(*CHANNEL_KEY).agg(((F.max("v") + F.min("v")) / 2).alias("mid"), ((F.max("v") - F.min("v")) / 2).alias("half"))
    stats = ok.join(ends, list(CHANNEL_KEY)).groupBy(*CHANNEL_KEY, "half").agg((100 * F.avg((F.abs(F.col("v") - F.col("mid")) >= 0.95 * F.col("half")).cast("double"))).alias("value"))
    return results(stats, CHANNEL_KEY, "limit_proximity_pct", "%", F.col("value"), first_reason((F.col("half") <= 0, "no range")))


def _power_share(group: pd.DataFrame) -> pd.DataFrame:
    g = group.sort_values("row_idx")
    v = g["v"].to_numpy(float)
    steps = np.diff(g["t"].to_numpy(float))
    keys = {k: g[k].iloc[0] for k in CHANNEL_KEY}
    bad = bool(~np.isfinite(v).all())
    dt = float(np.median(steps)) if len(steps) else math.nan
    share = math.nan
    if not bad and len(v) > 1 and dt > 0:
        power = np.abs(np.fft.rfft(v - v.mean())) ** 2
        total = power.sum()
        share = float(power[np.fft.rfftfreq(len(v), dt) > 20].sum() / total) if total > 0 else math.nan
    return pd.DataFrame([keys | {"n": len(v), "bad": bad, "rate": 1 / dt if dt > 0 else None, "share": None if math.isnan(share) else share}])


@metric("hf_vibration_ratio", level="channel", family="motion", unit="fraction", requires=Requires((JOINT_TORQUE,), 32, True))
def hf_vibration_ratio(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Power above 20 Hz over all power of the series without its mean.

    A channel of an episode is one recorded series; its spectrum needs it whole.
    """
    stats = samples.groupBy(*CHANNEL_KEY).applyInPandas(_power_share, "episode_id string, stream string, channel string, n bigint, bad boolean, rate double, share double")
    why = first_reason((F.col("n") < 32, "too few samples"), (F.col("bad"), "values not finite"), (~F.coalesce(F.col("rate") > 40, F.lit(False)), "sample rate too low"), (F.col("share").isNull(), "no power"))
    return results(stats, CHANNEL_KEY, "hf_vibration_ratio", "fraction", F.col("share"), why)


def _torque(samples: DataFrame, name: str, value) -> DataFrame:
    stats = samples.where(finite(F.col("v"))).withColumn("a", F.abs("v")).groupBy(*CHANNEL_KEY).agg(value.alias("value"))
    return results(stats, CHANNEL_KEY, name, "N·m", F.col("value"), F.lit(None).cast("string"))


@metric("p99_torque", level="channel", family="motion", unit="N·m", requires=Requires((JOINT_TORQUE,), 2))
def p99_torque(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    return _torque(samples, "p99_torque", nearest_rank(F.col("a"), 0.99))


@metric("max_torque", level="channel", family="motion", unit="N·m", requires=Requires((JOINT_TORQUE,), 2))
def max_torque(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    return _torque(samples, "max_torque", F.max("a"))


@metric("mean_torque", level="channel", family="motion", unit="N·m", requires=Requires((JOINT_TORQUE,), 2))
def mean_torque(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    return _torque(samples, "mean_torque", F.avg("a"))


@metric("energy_proxy", level="episode", family="motion", unit="J", requires=Requires((JOINT_TORQUE, JOINT_VELOCITY)))
def energy_proxy(samples: DataFrame, streams: DataFrame | None = None, torque: str = "torque", velocity: str = "velocity") -> DataFrame:
    """Sum of |torque * velocity| over paired channels times the median step; times have to agree within 1e-6 s."""
    a = samples.where(F.col("stream") == torque).select("episode_id", "channel", "row_idx", "t", F.col("v").alias("tau"))
    b = samples.where(F.col("stream") == velocity).select("episode_id", "channel", "row_idx", F.col("t").alias("t2"), F.col("v").alias("omega"))
    both = a.join(b, ["episode_id", "channel", "row_idx"])
    work = both.groupBy("episode_id").agg(F.sum(F.abs(F.col("tau") * F.col("omega"))).alias("work"), F.bool_and(F.abs(F.col("t") - F.col("t2")) <= 1e-6).alias("same"))
    dt = _median_step(samples.where(F.col("stream") == torque)).select("episode_id", "dt")
    every = samples.select("episode_id").distinct()
    stats = every.join(work, "episode_id", "left").join(dt, "episode_id", "left")
    why = first_reason((F.col("work").isNull(), "no paired torque and velocity"), (~F.col("same"), "timelines differ"))
    return results(stats, ("episode_id",), "energy_proxy", "J", F.col("work") * F.col("dt"), why)
