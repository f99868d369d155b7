"""Gates: what a subject must be before it is measured, selected or compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import STREAM_KEY, WS, finite
from .registry import METRICS, Metric

UNMAPPED = "unmapped"
DEPTH = ("camera.depth",)


def requirements(spark: SparkSession, metrics: list[Metric] | None = None) -> DataFrame:
    """(metric, level, needs, least, regular_only): a row for each registered metric."""
    rows = [(m.name, m.level, list(m.requires.taxonomy), m.requires.samples, m.requires.regular) for m in (metrics or METRICS.values())]
    return spark.createDataFrame(rows, "metric string, level string, needs array<string>, least int, regular_only boolean")


def stream_sizes(samples: DataFrame) -> DataFrame:
    """Rows of each stream, whatever the number of its channels."""
    return samples.groupBy(*STREAM_KEY).agg(F.count_distinct("row_idx").alias("rows"))


def gated(results: DataFrame, needed: DataFrame, streams: DataFrame, sizes: DataFrame) -> DataFrame:
    """Results of streams and channels under their metrics' requirements; the first unmet one is the reason.

    In this order: taxonomy, regularity, samples.  A wrong taxonomy makes a
    metric not applicable, unless the stream is not mapped to any; all else that
    is unmet leaves it unavailable.  A result's own reason stays where all is met.
    """
    facts = streams.select(*STREAM_KEY, F.col("taxonomy").alias("_taxonomy"), F.col("regular").alias("_regular")).join(sizes, list(STREAM_KEY), "left")
    rows = results.join(F.broadcast(needed.drop("level")), "metric", "left").join(facts, list(STREAM_KEY), "left")
    other = (F.size("needs") > 0) & ~F.coalesce(F.array_contains("needs", F.col("_taxonomy")), F.lit(False))
    uneven = F.col("regular_only") & ~F.coalesce("_regular", F.lit(False))
    few = F.coalesce("rows", F.lit(0)) < F.col("least")
    why = (
        F.when(other, F.concat(F.lit("needs one of "), F.array_join(F.array_sort("needs"), ", "), F.lit(", got "), F.coalesce("_taxonomy", F.lit("none"))))
        .when(uneven, "sampling is not regular")
        .when(few, F.concat(F.lit("fewer than "), F.col("least").cast("string"), F.lit(" samples")))
    )
    mapped = ~F.coalesce("_taxonomy", F.lit(UNMAPPED)).startswith(UNMAPPED)
    state = F.when(other & mapped, "not_applicable").when(why.isNotNull(), "unavailable").when(F.col("availability") == "computed", "computed").otherwise("unavailable")
    return rows.withColumns({"_why": why, "_state": state}).select(
        *[c for c in results.columns if c not in ("value", "availability", "reason")], F.when(F.col("_why").isNull(), F.col("value")).alias("value"), F.col("_state").alias("availability"), F.coalesce("_why", "reason").alias("reason")
    )


def episode_gate(episodes: DataFrame, streams: DataFrame, needs: list[str]) -> DataFrame:
    """(episode_id, reason): the taxonomies of ``needs`` that no stream of the episode has; null where all are there."""
    have = streams.groupBy("episode_id").agg(F.collect_set("taxonomy").alias("have"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, needs)).cast("array<string>"), F.coalesce("have", F.array().cast("array<string>"))))
    rows = episodes.select("episode_id").distinct().join(have, "episode_id", "left")
    return rows.select("episode_id", F.when(F.size(missing) > 0, F.concat(F.lit("episode carries no "), F.array_join(missing, ", "), F.lit(" stream"))).alias("reason"))


def is_camera(kind: Column, taxonomy: Column) -> Column:
    """An image or video that isn't a depth map."""
    return kind.isin("image", "video") & ~F.coalesce(taxonomy.isin(*DEPTH), F.lit(False))


def select_one(streams: DataFrame, **wanted) -> DataFrame:
    """The one stream with these values; none or several is an error."""
    found = streams
    for name, value in wanted.items():
        found = found.where(F.col(name).eqNullSafe(F.lit(value)))
    n = len(found.limit(2).collect())
    if n != 1:
        raise ValueError(f"{'no' if n == 0 else 'more than one'} stream matches {wanted}")
    return found


def increasing_axis(samples: DataFrame) -> DataFrame:
    """Per stream: rows, finite ticks, and why its clock can't order it; null where ticks are two or more, finite and strictly increasing."""
    rows = samples.groupBy(*STREAM_KEY, "row_idx").agg(F.first("native").alias("native"))
    step = F.col("native") - F.lag("native").over(WS())
    stats = rows.withColumn("step", step).groupBy(*STREAM_KEY).agg(F.count("*").alias("rows"), F.count(F.when(finite(F.col("native").cast("double")), 1)).alias("ticks"), F.min("step").alias("least"))
    why = F.when(F.col("ticks") < F.col("rows"), "ticks are not finite").when(F.col("ticks") < 2, "fewer than two ticks").when(F.col("least") <= 0, "ticks do not increase")
    return stats.select(*STREAM_KEY, "rows", "ticks", why.alias("reason"))


def unclaimed(candidates: DataFrame, claimed: DataFrame) -> DataFrame:
    """Candidate paths that lie in no claimed folder: each path asks with its own parents, so that no pair is tried in vain."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    hit = candidates.select("path", F.explode(above).alias("folder")).join(claimed.select(F.rtrim("path", F.lit("/")).alias("folder")).distinct(), "folder", "left_semi").select("path").distinct()
    return candidates.join(hit, "path", "left_anti")


def touched_windows(findings: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows (episode_id, stream, window, first, last) with the number of findings that touch their rows.

    A finding without a stream is of all streams of its episode; one without
    rows (null first and last) is of all rows.
    """
    f = findings.select(F.col("episode_id").alias("_episode"), F.col("stream").alias("_stream"), F.col("first").alias("_first"), F.col("last").alias("_last"), F.lit(1).alias("_one"))
    meets = (F.col("episode_id") == F.col("_episode")) & (F.col("_stream").isNull() | (F.col("_stream") == F.col("stream"))) & (F.col("_first").isNull() | ((F.col("_first") <= F.col("last")) & (F.col("_last") >= F.col("first"))))
    return windows.join(f, meets, "left").groupBy("episode_id", "stream", "window").agg(F.count("_one").alias("findings"))


def skipped(streams: DataFrame, metrics: list[Metric]) -> DataFrame:
    """The metadata tier: no payload is read, and every metric of every stream is recorded as skipped."""
    names = F.explode(F.array(*[F.lit(m.name) for m in metrics])).alias("metric")
    return streams.select(*STREAM_KEY, "taxonomy", names).withColumns({"value": F.lit(None).cast("double"), "availability": F.lit("skipped"), "reason": F.lit("payload not read")})


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
