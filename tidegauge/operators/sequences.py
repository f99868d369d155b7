"""Sequence operators over source order: runs, rolling windows, unwrapping, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CHANNEL_KEY, W, finite
from .parts import PART_KEY, parted


def with_previous(samples: DataFrame) -> DataFrame:
    """Adds prev (the value a row before) and pair (both finite): pairs break at a value that isn't, they don't bridge it."""
    prev = F.lag("v").over(W())
    return samples.withColumn("prev", prev).withColumn("pair", finite(F.col("v")) & finite(F.col("prev")))


def islands(df: DataFrame, keys: tuple[str, ...], flag: Column, order: str = "row_idx") -> DataFrame:
    """Adds island, the number of changes of the flag so far: equal within a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = flag.eqNullSafe(F.lag(flag).over(w))
    changed = F.when(F.row_number().over(w) == 1, 0).when(same, 0).otherwise(1)
    return df.withColumn("_change", changed).withColumn("island", F.sum("_change").over(w)).drop("_change")


def runs(df: DataFrame, keys: tuple[str, ...], flag: Column, order: str = "row_idx") -> DataFrame:
    """Maximal runs where the flag holds: first and last place, and rows."""
    return islands(df, keys, flag, order).where(flag).groupBy(*keys, "island").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("length")).drop("island")


def equal_runs(samples: DataFrame) -> DataFrame:
    """Runs of unchanged finite values: keys, start, length in pairs."""
    rows = with_previous(samples)
    return runs(rows, CHANNEL_KEY, F.coalesce(F.col("pair") & (F.col("v") == F.col("prev")), F.lit(False)))


def longest_run(samples: DataFrame) -> DataFrame:
    """The longest run of unchanged values of each channel, the first of equals.

    Runs are found within parts of a channel; those at a part's ends are joined to their neighbours' by the few pieces that the parts leave.
    """
    w = Window.partitionBy(*PART_KEY).orderBy("row_idx")
    ok = F.coalesce(finite(F.col("v")), F.lit(False))
    same = F.coalesce(ok & (F.col("v") == F.lag("v").over(w)) & F.lag(ok).over(w), F.lit(False))
    rows = parted(samples).withColumns({"_same": same, "_pos": F.row_number().over(w)})
    # a part's first row opens run 0, each other row that isn't the same opens the next
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_same") | (F.col("_pos") == 1), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.when(F.col("_same"), F.col("row_idx"))
    each = rows.groupBy(*PART_KEY, "_run").agg(F.count(inside).alias("length"), F.min(inside).alias("start"), F.max(inside).alias("stop"), F.min("row_idx").alias("_from"), F.max_by("v", "_pos").alias("_v"))
    piece = F.struct("length", "start", "stop")
    ends = each.groupBy(*PART_KEY).agg(
        F.max("_run").alias("_last"),
        F.max_by(piece, "_run").alias("_tail"),
        F.max_by("_v", "_run").alias("_v"),
        F.max(F.when(F.col("_run") == 0, piece)).alias("_head"),
        F.max(F.when(F.col("_run") == 0, F.struct("_from", "_v"))).alias("_first"),
        F.max(F.when(F.col("length") > 0, F.struct("length", (-F.col("start")).alias("_back"), "stop"))).alias("_best"),
    )
    parts = Window.partitionBy(*CHANNEL_KEY).orderBy("chunk")
    before, first = F.lag("_v").over(parts), F.col("_first._v")
    joined = F.coalesce(finite(first), F.lit(False)) & F.coalesce(finite(before), F.lit(False)) & F.coalesce(first == before, F.lit(False))
    none = F.struct(F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("stop"))
    at = lambda k, flag, p: F.struct(F.lit(k).alias("k"), flag.alias("same"), p.alias("p"), (p.getField("length") > 0).alias("some"))
    opened = F.struct(F.when(F.col("_joined"), 1).otherwise(0).cast("bigint").alias("length"), F.col("_first._from").alias("start"), F.col("_first._from").alias("stop"))
    pieces = F.array(at(0, F.col("_joined"), opened), at(1, F.lit(True), F.col("_head")), at(2, F.col("_last") == 0, none), at(3, F.lit(True), F.when(F.col("_last") > 0, F.col("_tail")).otherwise(none)), at(4, F.lit(True), F.struct("_best.length", (-F.col("_best._back")).alias("start"), "_best.stop")))
    long = ends.withColumn("_joined", joined).select(*PART_KEY, F.explode(pieces).alias("e")).select(*PART_KEY, "e.*")
    whole = Window.partitionBy(*CHANNEL_KEY).orderBy("chunk", "k").rowsBetween(Window.unboundedPreceding, 0)
    # the best run within a part stands for itself
    alone = F.when(F.col("k") == 4, F.col("chunk")).alias("_alone")
    found = long.withColumn("_run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(whole)).where("some").groupBy(*CHANNEL_KEY, "_run", alone).agg(F.min("p.start").alias("start"), F.max("p.stop").alias("stop"), F.sum("p.length").alias("length")).drop("_run", "_alone")
    best = Window.partitionBy(*CHANNEL_KEY).orderBy(F.desc("length"), "start")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def full_window(value: Column, c: Column, half: int) -> Column:
    """The windowed value where all 2 * half + 1 rows are there and not null."""
    return F.when(F.count(c).over(W().rowsBetween(-half, half)) == 2 * half + 1, value)


def leave_one_out(samples: DataFrame, half: int = 25) -> DataFrame:
    """Mean and population deviation of the other rows of a centred window: others_mean, others_std; null at the edges."""
    x = F.when(finite(F.col("v")), F.col("v"))
    frame, n = W().rowsBetween(-half, half), 2.0 * half
    s, q = F.sum(x).over(frame), F.sum(x * x).over(frame)
    mean = (s - x) / n
    var = F.greatest((q - x * x) / n - mean * mean, F.lit(0.0))
    return samples.withColumn("others_mean", full_window(mean, x, half)).withColumn("others_std", full_window(F.sqrt(var), x, half))


def smooth(samples: DataFrame, half: int = 2) -> DataFrame:
    """Centred mean of 2 * half + 1 finite rows: smooth; null at the edges and near any that isn't."""
    x = F.when(finite(F.col("v")), F.col("v"))
    return samples.withColumn("smooth", full_window(F.avg(x).over(W().rowsBetween(-half, half)), x, half))


def differences(samples: DataFrame) -> DataFrame:
    """d1 = v[i+1] - v[i], and d3 = v[i+3] - 3 v[i+2] + 3 v[i+1] - v[i], where the rows are there."""
    v, a, b, c = F.col("v"), *[F.lead("v", k).over(W()) for k in (1, 2, 3)]
    return samples.withColumns({"d1": a - v, "d3": c - 3 * b + 3 * a - v})


def detrended(samples: DataFrame, half: int = 12) -> DataFrame:
    """Minus a centred mean whose frame shrinks at the edges."""
    return samples.withColumn("detrended", F.col("v") - F.avg("v").over(W().rowsBetween(-half, half)))


def neighbour_max(samples: DataFrame) -> DataFrame:
    """The greatest of a row and its two neighbours."""
    return samples.withColumn("near_max", F.max("v").over(W().rowsBetween(-1, 1)))


def robust_z(samples: DataFrame) -> DataFrame:
    """(x - median) / (1.4826 * MAD); where that is 0, by the median of the nonzero deviations, else 0."""
    key = list(CHANNEL_KEY)
    rows = samples.where(finite(F.col("v")))
    rows = rows.join(rows.groupBy(*key).agg(F.median("v").alias("_m")), key).withColumn("_d", F.abs(F.col("v") - F.col("_m")))
    spread = rows.groupBy(*key).agg(F.median("_d").alias("_mad"), F.median(F.when(F.col("_d") > 0, F.col("_d"))).alias("_near"))
    unit = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).otherwise(F.col("_near"))
    return rows.join(spread, key).withColumn("z", F.when(unit > 0, (F.col("v") - F.col("_m")) / unit).otherwise(0.0)).drop("_m", "_d", "_mad", "_near")


def _middle(values: Column) -> Column:
    s = F.sort_array(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def local_ratio(samples: DataFrame, half: int = 6) -> DataFrame:
    """A value over the median of its neighbours on either side, which is never under the channel's lower quartile."""
    floor = samples.groupBy(*CHANNEL_KEY).agg(F.percentile("v", F.lit(0.25)).alias("_floor"))
    around = F.concat(F.collect_list("v").over(W().rowsBetween(-half, -1)), F.collect_list("v").over(W().rowsBetween(1, half)))
    rows = samples.withColumn("_around", around).join(floor, list(CHANNEL_KEY))
    base = F.greatest(_middle(F.col("_around")), F.col("_floor"))
    return rows.withColumn("ratio", F.when(base > 0, F.col("v") / base)).drop("_around", "_floor")


def unwrapped(samples: DataFrame, period: float = 2 * math.pi) -> DataFrame:
    """Angles without jumps of whole periods; values that aren't finite stay where they are and are skipped."""
    ok = finite(F.col("v"))
    good = samples.where(ok)
    turns = F.sum(F.coalesce(-F.rint((F.col("v") - F.lag("v").over(W())) / period), F.lit(0.0))).over(W().rowsBetween(Window.unboundedPreceding, 0))
    return good.withColumn("unwrapped", F.col("v") + turns * period).unionByName(samples.where(~ok | ok.isNull()).withColumn("unwrapped", F.col("v")))


def monotonic_fraction(samples: DataFrame) -> DataFrame:
    """Share of steps between non-null values that don't go down; nulls are bridged."""
    steps = samples.where("v IS NOT NULL").withColumn("_p", F.lag("v").over(W())).where("_p IS NOT NULL")
    return steps.groupBy(*CHANNEL_KEY).agg(F.avg((F.col("v") >= F.col("_p")).cast("double")).alias("fraction"))


def support_intervals(rows: DataFrame, keys: tuple[str, ...], margin: int = 0, last: str | None = None) -> DataFrame:
    """Places merged into half-open intervals [start, stop), each place widened by a margin, from 0 up to a last row."""
    stop = F.col("row_idx") + margin + 1
    spans = rows.select(*keys, F.greatest(F.col("row_idx") - margin, F.lit(0)).alias("start"), (F.least(stop, F.col(last) + 1) if last else stop).alias("stop"))
    return merged_intervals(spans, keys)


def merged_intervals(spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Overlapping or touching [start, stop) become one."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    seen = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(seen.isNull() | (F.col("start") > seen), 1).otherwise(0)).withColumn("_group", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_group")


def split_intervals(spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The cover of the spans, cut at every bound of any of them."""
    bounds = spans.select(*keys, F.explode(F.array("start", "stop")).alias("start")).distinct()
    pieces = bounds.withColumn("stop", F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))).where("stop IS NOT NULL")
    cover = merged_intervals(spans, keys).select(*keys, F.col("start").alias("_a"), F.col("stop").alias("_b"))
    return pieces.join(cover, list(keys)).where("start >= _a AND stop <= _b").drop("_a", "_b")


def cumulative_flips(samples: DataFrame, dot: Column) -> Column:
    """Hemisphere sign after each row: -1 after an odd number of negative products."""
    return F.when(F.pmod(F.sum(F.when(dot < 0, 1).otherwise(0)).over(W().rowsBetween(Window.unboundedPreceding, 0)), F.lit(2)) == 1, -1.0).otherwise(1.0)


def change_point(df: DataFrame, keys: tuple[str, ...], order: str, value: str, least: int = 5) -> DataFrame:
    """The split with least squares within both groups, at least so many rows each; the first of equals."""
    w = Window.partitionBy(*keys).orderBy(order)
    past, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    x = F.col(value)
    rows = df.select(*keys, order, F.row_number().over(w).alias("k"), F.count("*").over(whole).alias("n"), F.sum(x).over(past).alias("s"), F.sum(x * x).over(past).alias("q"), F.sum(x).over(whole).alias("all_s"), F.sum(x * x).over(whole).alias("all_q"))
    k, n, s, q, all_s, all_q = (F.col(c) for c in ("k", "n", "s", "q", "all_s", "all_q"))
    cost = (q - s * s / k) + (all_q - q - (all_s - s) * (all_s - s) / (n - k))
    rows = rows.where((k >= least) & (n - k >= least)).withColumn("cost", cost)
    best = Window.partitionBy(*keys).orderBy(F.round("cost", 9), "k")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, F.col("k").alias("split"), "cost")


def numbered_runs(df: DataFrame, keys: tuple[str, ...], number: str) -> DataFrame:
    """Runs of consecutive numbers as text, ``3-7`` or ``9``, and their first number."""
    w = Window.partitionBy(*keys).orderBy(number)
    rows = df.select(*keys, number).distinct().withColumn("_g", F.col(number) - F.row_number().over(w))
    out = rows.groupBy(*keys, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_g")
    return out.withColumn("label", F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last")))
