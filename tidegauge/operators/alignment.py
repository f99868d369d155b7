"""Joins in time: nearest and previous matches, tracking, training windows, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Clocks are compared in whole nanoseconds; no floating point decides what came first.


def clock_transform(t: Column, offset_ns: int = 0, drift_ppb: int = 0, anchor_ns: int = 0) -> Column:
    """A right clock's ticks in the left domain: offset, and drift in parts per billion from an anchor."""
    return t + offset_ns + F.floor((t - anchor_ns) * drift_ppb / 1_000_000_000).cast("bigint")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], *, value: str = "v", tolerance: int | None = None, direction: str = "nearest") -> DataFrame:
    """Each left row (keys, t, ...) with the right row's t and value that is nearest, or last before, within a tolerance.

    Both sides are put in one order of time by key and carried over with
    windows: one shuffle on the key, no pairs.  Of equally near ones the earlier
    is taken, of equal times on the right the last by value.
    """
    rest = [c for c in left.columns if c not in (*keys, "t")]
    a = left.select(*keys, "t", F.struct(*rest).alias("_left"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*keys, "t", F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = a.unionByName(b)
    mark = F.when(F.col("_side") == 0, F.struct(F.col("t").alias("t"), F.col("_v").alias("v")))
    order = Window.partitionBy(*keys).orderBy("t", "_side", "_v")
    back = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(mark, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = both.withColumns({"_back": back, "_ahead": ahead}).where("_side = 1")
    if direction == "previous":
        chosen = F.col("_back")
    else:
        near = F.col("_back.t").isNotNull() & (F.col("_ahead.t").isNull() | (F.col("t") - F.col("_back.t") <= F.col("_ahead.t") - F.col("t")))
        chosen = F.when(near, F.col("_back")).otherwise(F.col("_ahead"))
    rows = rows.withColumn("_m", chosen)
    if tolerance is not None:
        rows = rows.withColumn("_m", F.when(F.abs(F.col("_m.t") - F.col("t")) <= tolerance, F.col("_m")))
    return rows.select(*keys, "t", *[F.col("_left")[c].alias(c) for c in rest], F.col("_m.t").alias("match_t"), F.col("_m.v").alias("match_v"))


def timing_report(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Per key: left rows, the matched share, median skew, 95th percentile of |skew| and of the causal age."""
    near = as_of(left, right, keys, tolerance=tolerance)
    skew = F.col("match_t") - F.col("t")
    a = near.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("match_t").isNotNull().cast("double")).alias("matched"), F.median(skew).alias("skew_median"), F.percentile(F.abs(skew), F.lit(0.95)).alias("skew_p95"))
    past = as_of(left, right, keys, direction="previous")
    b = past.groupBy(*keys).agg(F.percentile(F.col("t") - F.col("match_t"), F.lit(0.95)).alias("age_p95"))
    return a.join(b, keys)


def event_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Offset and drift of declared (left_t, right_t) pairs by least squares, and the residual's root mean square."""
    fit = pairs.groupBy(*keys).agg(F.regr_slope("left_t", "right_t").alias("slope"), F.regr_intercept("left_t", "right_t").alias("intercept"), F.count("*").alias("n"))
    rest = F.col("left_t") - F.col("intercept") - F.col("slope") * F.col("right_t")
    return pairs.join(fit, keys).groupBy(*keys, "slope", "intercept", "n").agg(F.sqrt(F.avg(rest * rest)).alias("rms"))


def tracking_report(command: DataFrame, state: DataFrame, keys: list[str], *, delay: int, tolerance: int, semantics: str = "absolute") -> DataFrame:
    """Per key: how well the state follows the command now, and ``delay`` later.

    absolute compares values; delta compares the state's change over the delay,
    rate that change a second, with the command.
    """
    now = as_of(command, state, keys, tolerance=tolerance).select(*keys, "t", F.col("v").alias("command"), F.col("match_v").alias("now"))
    later = command.select(*keys, (F.col("t") + delay).alias("t"), "v", F.col("t").alias("sent"))
    then = as_of(later, state, keys, tolerance=tolerance).select(*keys, F.col("sent").alias("t"), F.col("match_v").alias("later"))
    both = now.join(then, [*keys, "t"]).where("now IS NOT NULL AND later IS NOT NULL")
    change = F.col("later") - F.col("now")
    got = {"absolute": F.col("later"), "delta": change, "rate": change / (delay / 1e9)}[semantics]
    raw = (F.col("now") if semantics == "absolute" else got) - F.col("command")
    error = got - F.col("command")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(raw * raw)).alias("rmse_now"), F.sqrt(F.avg(error * error)).alias("rmse_later"), F.percentile(F.abs(error), F.lit(0.95)).alias("p95"), F.avg(error).alias("mean"))


def training_windows(episodes: DataFrame, modalities: DataFrame, *, step: int, history: int, prediction: int, stride: int, max_age: int) -> DataFrame:
    """Windows on a grid of whole steps, and whether each modality has a sample young enough at every step.

    episodes: episode_id, start, stop; modalities: episode_id, modality, t.
    Columns: episode_id, window, missing (probes without a sample), status.
    """
    length = history + prediction
    last = F.floor((F.col("stop") - F.col("start")) / step) - length + 1
    grid = episodes.where(last >= 0).select("episode_id", "start", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(stride).cast("bigint"))).alias("window"))
    steps = episodes.where(last >= 0).select("episode_id", "start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("stop") - F.col("start")) / step))).alias("k"))
    kinds = modalities.select("episode_id", "modality").distinct()
    probes = steps.join(kinds, "episode_id").select("episode_id", "modality", "k", (F.col("start") + F.col("k") * step).alias("t"))
    found = as_of(probes, modalities.withColumn("v", F.lit(1)), ["episode_id", "modality"], direction="previous")
    miss = found.withColumn("miss", (F.col("match_t").isNull() | (F.col("t") - F.col("match_t") > max_age)).cast("int"))
    # a window's probes are a run of steps: the difference of two running counts, not a join of windows with steps
    run = Window.partitionBy("episode_id", "modality").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    counts = miss.withColumn("total", F.sum("miss").over(run)).groupBy("episode_id", "k").agg(F.sum("total").alias("total"))
    ends = counts.select("episode_id", (F.col("k") - length + 1).alias("window"), F.col("total").alias("b"))
    starts = counts.select("episode_id", (F.col("k") + 1).alias("window"), F.col("total").alias("a"))
    out = grid.join(ends, ["episode_id", "window"]).join(starts, ["episode_id", "window"], "left")
    missing = F.col("b") - F.coalesce("a", F.lit(0))
    return out.select("episode_id", "window", missing.alias("missing"), F.when(missing == 0, "pass").otherwise("unknown").alias("status"))


def budgeted(windows: DataFrame, most: int) -> DataFrame:
    """Windows beyond a budget are marked skipped, in order; none is dropped."""
    w = Window.partitionBy("episode_id").orderBy("window")
    return windows.withColumn("status", F.when(F.row_number().over(w) > most, "skipped").otherwise(F.col("status")))


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Points (keys, at) with the [start, stop) intervals they are in.

    Intervals are listed in the buckets of ``width`` that they touch, so the join
    is on key and bucket and not of all points with all intervals.
    """
    a = points.withColumn("_bucket", F.floor(F.col("at") / width))
    b = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    return a.join(b, [*keys, "_bucket"]).where("at >= start AND at < stop").drop("_bucket")


def segments(samples: DataFrame, keys: list[str], max_gap: float) -> DataFrame:
    """Adds segment: a new one begins after a gap, a missing row, or a value that isn't finite."""
    w = Window.partitionBy(*keys).orderBy("row_idx")
    bad = ~(F.col("v").isNotNull() & ~F.isnan("v"))
    cut = (F.col("t") - F.lag("t").over(w) > max_gap) | (F.col("row_idx") - F.lag("row_idx").over(w) != 1) | bad | F.lag(bad).over(w)
    return samples.withColumn("_cut", F.coalesce(cut, F.lit(True)).cast("int")).withColumn("segment", F.sum("_cut").over(w)).drop("_cut")


def segment_motion(samples: DataFrame, keys: list[str], max_gap: float) -> DataFrame:
    """Per segment: rows, greatest speed, changes of direction."""
    rows = segments(samples, keys, max_gap).where("v IS NOT NULL AND NOT isnan(v)")
    w = Window.partitionBy(*keys, "segment").orderBy("row_idx")
    rows = rows.withColumn("d", (F.col("v") - F.lag("v").over(w)) / (F.col("t") - F.lag("t").over(w)))
    rows = rows.withColumn("turn", (F.signum("d") * F.signum(F.lag("d").over(w)) < 0).cast("int"))
    return rows.groupBy(*keys, "segment").agg(F.count("*").alias("n"), F.max(F.abs("d")).alias("max_speed"), F.coalesce(F.sum("turn"), F.lit(0)).alias("turns"))


def cross_correlation(pairs: DataFrame, keys: list[str], *, most: int = 10, least: int = 10) -> DataFrame:
    """Pearson's r of x(k) and y(k + lag) for lags from -most to most, over at least so many rows; pairs: keys, k, x, y."""
    lagged = pairs.select(*keys, "k", "x").withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("_k", F.col("k") + F.col("lag"))
    other = pairs.select(*keys, F.col("k").alias("_k"), "y")
    joined = lagged.join(other, [*keys, "_k"])
    return joined.groupBy(*keys, "lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")).where(F.col("n") >= least)


def best_lag(curve: DataFrame, keys: list[str]) -> DataFrame:
    """The lag of the greatest r (the first of equals), moved by the parabola through its neighbours."""
    w = Window.partitionBy(*keys).orderBy("lag")
    rows = curve.withColumns({"a": F.lag("r").over(w), "c": F.lead("r").over(w)})
    top = Window.partitionBy(*keys).orderBy(F.desc(F.round("r", 9)), "lag")
    rows = rows.withColumn("_n", F.row_number().over(top)).where("_n = 1")
    bend = F.col("a") - 2 * F.col("r") + F.col("c")
    shift = F.when(bend < 0, 0.5 * (F.col("a") - F.col("c")) / bend).otherwise(0.0)
    return rows.select(*keys, "lag", "r", (F.col("lag") + F.coalesce(shift, F.lit(0.0))).alias("refined"))


def _counted(points: DataFrame, frames: DataFrame, keys: list[str], at: str, name: str, inclusive: bool) -> DataFrame:
    """Points with the number of frames before ``at`` (up to it if inclusive): one window pass over both."""
    marks = points.select(*keys, F.col("_id"), F.col(at).alias("_t"), F.lit(1 if inclusive else 0).alias("_kind"))
    ticks = frames.select(*keys, F.lit(None).cast("bigint").alias("_id"), F.col("t").alias("_t"), F.lit(0 if inclusive else 1).alias("_kind"))
    w = Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.unionByName(ticks).withColumn(name, F.sum(F.when(F.col("_id").isNull(), 1).otherwise(0)).over(w))
    return points.join(rows.where("_id IS NOT NULL").select(*keys, "_id", name), [*keys, "_id"])


def frames_spanned(steps: DataFrame, frames: DataFrame, keys: list[str], share: float = 1e-3) -> DataFrame:
    """The first and last frame onto whose incoming step each control step (a, b] falls; null where it falls before the second or after the last.

    steps: keys, _id (whole number), a, b; frames: keys, t, ascending.  Times
    within ``share`` of the usual frame gap count as equal.
    """
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t"))
    usual = frames.withColumn("gap", gap).groupBy(*keys).agg(F.count("*").alias("frames"), (F.coalesce(F.median("gap"), F.lit(0.0)) * share).alias("near"))
    rows = steps.join(usual, keys).withColumns({"_from": F.col("a") + F.col("near"), "_to": F.col("b") - F.col("near")})
    rows = _counted(rows, frames, keys, "_from", "first", True)
    rows = _counted(rows, frames, keys, "_to", "last", False).withColumn("last", F.greatest("last", "first"))
    out = (F.col("last") < 1) | (F.col("first") > F.col("frames") - 1)
    inside = lambda c: F.when(~out, F.least(F.greatest(F.col(c), F.lit(1)), F.col("frames") - 1))
    return rows.select(*keys, "_id", "a", "b", inside("first").alias("first"), inside("last").alias("last"))


def on_frame_steps(control: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per step between frames the value of the control step that ends at the row nearest the step's second frame, the earlier of equals.

    control: keys, row_idx (from 0), t, step (the value of the step that ends at the row); frames: keys, frame (from 0), t.
    """
    w = Window.partitionBy(*keys).orderBy("_t", "_kind")
    rows = control.select(*keys, F.col("t").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("frame"), F.struct("t", "row_idx").alias("c")).unionByName(
        frames.where("frame > 0").select(*keys, F.col("t").alias("_t"), F.lit(1).alias("_kind"), F.col("frame").cast("bigint").alias("frame"), F.lit(None).cast("struct<t:double,row_idx:bigint>").alias("c"))
    )
    before = F.last("c", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("c", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = rows.withColumns({"p": before, "q": after}).where("frame IS NOT NULL")
    take_q = F.col("p").isNull() | (F.col("q").isNotNull() & ((F.col("q.t") - F.col("_t")) < (F.col("_t") - F.col("p.t"))))
    near = near.withColumn("row_idx", F.greatest(F.when(take_q, F.col("q.row_idx")).otherwise(F.col("p.row_idx")), F.lit(1)))
    return near.join(control.select(*keys, "row_idx", "step"), [*keys, "row_idx"], "left").select(*keys, (F.col("frame") - 1).alias("video_step"), "step")
