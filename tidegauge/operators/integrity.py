"""Integrity: missing, flat, spiking, drifting, noisy and dead signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CHANNEL_KEY, STREAM_KEY, finite, first_reason, results
from .parts import among, by_parts, is_switch, two_values, variance, with_mean, with_median
from .registry import Requires, metric
from .sequences import leave_one_out, longest_run, with_previous

# Fixed value: the taxonomy of tactile arrays.
TAXEL_PRESSURE = "extero.taxel_pressure"


def _per_channel(samples: DataFrame, stats: DataFrame) -> DataFrame:
    return samples.select(*CHANNEL_KEY).distinct().join(stats, list(CHANNEL_KEY), "left")


def switches(samples: DataFrame) -> DataFrame:
    """Per channel: whether it has exactly two distinct values, nulls aside."""
    return samples.groupBy(*CHANNEL_KEY).agg((F.count_distinct("v") == 2).alias("is_switch"))


@metric("missing_pct", level="channel", family="integrity", unit="%", requires=Requires(samples=1))
def missing_pct(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Null and NaN; infinities are there."""
    gone = (F.col("v").isNull() | F.isnan("v")).cast("int")
    stats = samples.groupBy(*CHANNEL_KEY).agg((100.0 * F.sum(gone) / F.count("*")).alias("value"))
    return results(stats, CHANNEL_KEY, "missing_pct", "%", F.col("value"), F.lit(None).cast("string"))


@metric("flatline_pct", level="channel", family="integrity", unit="%", requires=Requires(samples=2))
def flatline_pct(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Unchanged share of adjacent finite pairs."""
    ok = lambda c: F.coalesce(finite(c), F.lit(False))

    def values(w):
        prev = F.expr(f"lag(v) {w}")
        pair = ok(F.col("v")) & ok(prev)
        here = among(-1, w)
        return {"pair": (pair.cast("int"), here), "same": ((pair & (F.col("v") == prev)).cast("int"), here)}

    merged = {"n_": ("sum", F.lit(1)), "pairs": ("sum", F.col("pair")), "same": ("sum", F.col("same"))}
    rows = by_parts(samples, values, lambda w: ~among(-1, w) | ~among(1, w), merged, whole=two_values())
    stats = rows.groupBy(*CHANNEL_KEY).agg(F.sum("n_").alias("n"), F.sum("pairs").alias("pairs"), F.sum("same").alias("same"), is_switch().alias("is_switch"))
    why = first_reason((F.col("n") < 2, "too few samples"), (F.col("is_switch"), "two-valued switch"), (F.coalesce("pairs", F.lit(0)) < 1, "no adjacent finite pairs"))
    return results(stats, CHANNEL_KEY, "flatline_pct", "%", 100.0 * F.col("same") / F.col("pairs"), why)


def flatline_evidence(samples: DataFrame) -> DataFrame:
    """Per channel: the longest unchanged run (pairs and first row) and whether it never changed."""
    rows = with_previous(samples)
    stats = rows.groupBy(*CHANNEL_KEY).agg((F.sum((F.col("pair") & (F.col("v") != F.col("prev"))).cast("int")) == 0).alias("never_changed"))
    longest = longest_run(samples).select(*CHANNEL_KEY, F.col("length").alias("longest"), F.col("start").alias("longest_start"))
    return stats.join(longest, list(CHANNEL_KEY), "left").fillna({"longest": 0})


@metric("spike_pct", level="channel", family="integrity", unit="%", requires=Requires(samples=51))
def spike_pct(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Rows over six deviations from the others of their window of 51."""
    scored = F.col("others_std") > 0
    out = scored & (F.abs(F.col("v") - F.col("others_mean")) > 6 * F.col("others_std"))
    stats = leave_one_out(samples).groupBy(*CHANNEL_KEY).agg(F.count("*").alias("n"), F.sum(scored.cast("int")).alias("scored"), F.sum(out.cast("int")).alias("spikes"))
    why = first_reason((F.col("n") < 51, "too few samples"), (F.coalesce("scored", F.lit(0)) < 1, "no scored samples"))
    return results(stats, CHANNEL_KEY, "spike_pct", "%", 100.0 * F.coalesce("spikes", F.lit(0)) / F.col("scored"), why)


@metric("drift", level="channel", family="integrity", unit="per min", requires=Requires(samples=5))
def drift(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Least-squares slope a minute; nulls are left out."""
    ok = samples.where("v IS NOT NULL AND t IS NOT NULL")
    stats = ok.groupBy(*CHANNEL_KEY).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"), F.var_pop("v").alias("var"), F.regr_slope("v", "t").alias("slope"))
    why = first_reason((F.coalesce("n", F.lit(0)) < 5, "too few samples"), (F.col("span") <= 0, "no time span"), (F.col("var") <= 0, "no variance"))
    return results(_per_channel(samples, stats), CHANNEL_KEY, "drift", "per min", F.col("slope") * 60, why)


def drift_fit(samples: DataFrame) -> DataFrame:
    """Per channel: the share of variance that the slope explains."""
    ok = samples.where("v IS NOT NULL AND t IS NOT NULL")
    return ok.groupBy(*CHANNEL_KEY).agg(F.regr_r2("v", "t").alias("r2"))


#: Rate from which five samples span no more than a tenth of a second, with a tenth to spare.
SMOOTHING_HZ = 5 / (0.1 * 1.1)


@metric("snr_db", level="channel", family="integrity", unit="dB", requires=Requires(samples=8, regular=True))
def snr_db(samples: DataFrame, streams: DataFrame) -> DataFrame:
    """Variance of a smooth of five over that of the rest."""
    x = "CASE WHEN v IS NOT NULL AND NOT isnan(v) AND abs(v) <> double('infinity') THEN v END"

    def values(w):
        frame = w[:-1] + " ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
        mean = F.when(F.expr(f"count({x}) {frame}") == 5, F.expr(f"avg({x}) {frame}"))
        gap = F.col("t") - F.expr(f"lag(t) {w}")
        around = among(-2, w) & among(2, w)
        return {"smooth": (mean, around), "rest": (F.col("v") - mean, around), "gap": (F.when(gap > 0, gap), among(-1, w))}

    merged = {"n_": ("sum", F.lit(1)), "gaps": ("sum", F.col("gap").isNotNull().cast("int"))}
    rows = by_parts(samples, values, lambda w: ~among(-4, w) | ~among(4, w), merged, by="gap", whole=two_values(), moments=("smooth", "rest"))
    rows = with_median(with_mean(with_mean(rows, "smooth"), "rest"), CHANNEL_KEY, "gap", "gaps", "gap")
    stats = rows.groupBy(*CHANNEL_KEY).agg(F.sum("n_").alias("n"), variance("smooth", True).alias("signal"), variance("rest", True).alias("noise"), is_switch().alias("is_switch"), (1 / F.max("gap_hi")).alias("rate"))
    stats = stats.join(streams.select(*STREAM_KEY, "regular", "taxonomy"), list(STREAM_KEY))
    left_out = F.coalesce(F.col("taxonomy").rlike(r"^(reward|annotation|metadata)\."), F.lit(False))
    why = first_reason(
        (left_out, "not a measured signal"),
        (~F.col("regular"), "not regular"),
        (F.col("n") < 8, "too few samples"),
        (F.col("is_switch"), "two-valued switch"),
        (F.col("rate").isNull(), "no sample rate"),
        (F.col("rate") < SMOOTHING_HZ, "sample rate too low to smooth"),
        (F.col("signal").isNull() | F.col("noise").isNull(), "no smoothed samples"),
        ((F.col("signal") <= 0) | (F.col("noise") <= 0), "zero variance"),
    )
    return results(stats, CHANNEL_KEY, "snr_db", "dB", 10 * F.log10(F.col("signal") / F.col("noise")), why)


@metric("rotation_snr_db", level="stream", family="integrity", unit="dB")
def rotation_snr_db(samples: DataFrame, streams: DataFrame | None = None, names: tuple[str, ...] = ("qx", "qy", "qz", "qw"), tolerance: float = 1e-3) -> DataFrame:
    """Unit quaternions: signs aligned, smoothed over five, mean squared angles of signal over rest."""
    wide = samples.groupBy(*STREAM_KEY, "row_idx").agg(*[F.max(F.when(F.col("channel") == n, F.col("v"))).alias(n) for n in names])
    w = Window.partitionBy(*STREAM_KEY).orderBy("row_idx")
    norm = F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)))
    unit = wide.withColumn("ok", F.coalesce(F.abs(norm - 1) <= tolerance, F.lit(False)))
    unit = unit.withColumns({n: F.when(F.col("ok"), F.col(n) / norm) for n in names})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    dot = sum((F.col(n) * F.last(n, ignorenulls=True).over(before) for n in names), F.lit(0.0))
    signed = unit.withColumn("_flip", F.when(dot < 0, 1).otherwise(0)).withColumn("_sign", F.when(F.pmod(F.sum("_flip").over(w), F.lit(2)) == 1, -1.0).otherwise(1.0))
    frame = w.rowsBetween(-2, 2)
    signed = signed.withColumns({n: F.col(n) * F.col("_sign") for n in names})
    signed = signed.withColumns({f"s_{n}": F.when(F.count(n).over(frame) == 5, F.avg(n).over(frame)) for n in names})
    length = F.sqrt(sum((F.col(f"s_{n}") * F.col(f"s_{n}") for n in names), F.lit(0.0)))
    signed = signed.withColumn("_len", length)
    rows = signed.where(F.col("_len") > 0).select(*STREAM_KEY, *names, *[(F.col(f"s_{n}") / F.col("_len")).alias(f"s_{n}") for n in names])
    mean = rows.groupBy(*STREAM_KEY).agg(*[F.avg(f"s_{n}").alias(f"m_{n}") for n in names])
    mean = mean.withColumn("_m", F.sqrt(sum((F.col(f"m_{n}") * F.col(f"m_{n}") for n in names), F.lit(0.0))))

    def angle(a: str, b: str, scale=None):
        d = sum((F.col(f"{a}{n}") * F.col(f"{b}{n}") for n in names), F.lit(0.0))
        return 2 * F.acos(F.least(F.abs(d / scale if scale is not None else d), F.lit(1.0)))

    joined = rows.join(mean, list(STREAM_KEY)).select(*STREAM_KEY, angle("s_", "m_", F.col("_m")).alias("signal"), angle("", "s_").alias("rest"))
    stats = joined.groupBy(*STREAM_KEY).agg(F.avg(F.col("signal") ** 2).alias("signal"), F.avg(F.col("rest") ** 2).alias("rest"))
    whole = unit.groupBy(*STREAM_KEY).agg(F.count("*").alias("n"), F.sum((~F.col("ok")).cast("int")).alias("bad"))
    stats = whole.join(stats, list(STREAM_KEY), "left")
    why = first_reason((F.col("bad") > 0, "not unit quaternions"), (F.col("n") < 8, "too few samples"), (F.coalesce("signal", F.lit(0.0)) <= 0, "zero variance"), (F.coalesce("rest", F.lit(0.0)) <= 0, "zero variance"))
    return results(stats, STREAM_KEY, "rotation_snr_db", "dB", 10 * F.log10(F.col("signal") / F.col("rest")), why)


@metric("dead_taxel_pct", level="stream", family="integrity", unit="%", requires=Requires((TAXEL_PRESSURE,), 2))
def dead_taxel_pct(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """Cells with at most one distinct value; here a null is a value."""
    cells = samples.groupBy(*CHANNEL_KEY).agg(F.count("*").alias("n"), (F.count_distinct("v") + F.max(F.col("v").isNull().cast("int"))).alias("values"))
    stats = cells.groupBy(*STREAM_KEY).agg(F.max("n").alias("n"), (100 * F.avg((F.col("values") <= 1).cast("double"))).alias("dead"))
    return results(stats, STREAM_KEY, "dead_taxel_pct", "%", F.col("dead"), first_reason((F.col("n") < 2, "too few samples")))


@metric("hysteresis", level="stream", family="integrity", unit="fraction", requires=Requires((TAXEL_PRESSURE,), 8))
def hysteresis(samples: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """How unlike loading and unloading are about the first peak of the mean over channels."""
    mean = samples.groupBy(*STREAM_KEY, "row_idx").agg(F.avg("v").alias("a"))
    stats = mean.groupBy(*STREAM_KEY).agg(F.count("*").alias("n"), (F.max("a") - F.min("a")).alias("range"), F.max("a").alias("top"), F.max("row_idx").alias("last"), F.min("row_idx").alias("first"))
    peak = mean.join(stats.select(*STREAM_KEY, "top"), list(STREAM_KEY)).where("a = top").groupBy(*STREAM_KEY).agg(F.min("row_idx").alias("peak"))
    key = list(STREAM_KEY)
    left = mean.join(peak, key).where("row_idx < peak").withColumn("mirror", 2 * F.col("peak") - F.col("row_idx"))
    right = mean.select(*STREAM_KEY, F.col("row_idx").alias("mirror"), F.col("a").alias("b"))
    apart = left.join(right, [*key, "mirror"]).groupBy(*STREAM_KEY).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("apart"))
    stats = stats.join(peak, key, "left").join(apart, key, "left")
    why = first_reason((F.col("n") < 8, "too few samples"), (F.coalesce("range", F.lit(0.0)) <= 0, "no range"), ((F.col("peak") == F.col("first")) | (F.col("peak") == F.col("last")), "peak at an end"))
    return results(stats, STREAM_KEY, "hysteresis", "fraction", F.col("apart") / F.col("range"), why)


def noise_assessment(residuals: DataFrame, floors: DataFrame) -> DataFrame:
    """Residual deviation against a validated floor: below, near, above or unknown (no validated floor)."""
    both = residuals.join(floors, list(CHANNEL_KEY), "left")
    ratio = F.col("residual_std") / F.col("floor")
    state = F.when(F.col("floor").isNull() | ~F.coalesce("validated", F.lit(False)), "unknown").when(ratio < 0.5, "below").when(ratio <= 2, "near").otherwise("above")
    return both.select(*CHANNEL_KEY, "residual_std", "floor", state.alias("state"))
