"""The driver's tables as recordings, for the queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.places import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str):
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"(unix_date(CAST({ts} AS DATE)) * 86400L + hour({ts}) * 3600L + minute({ts}) * 60L) * 1000000L + CAST(date_part('SECOND', {ts}) * 1000000 AS BIGINT)")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight episodes with a stream for each kind of event, in order of time."""
    e = table(spark, sf_dir, "events")
    episode = F.concat(F.lit("ep"), F.col("user_id") % 8)
    w = Window.partitionBy(F.col("user_id") % 8, "event_type").orderBy("ts", "event_id")
    rows = e.select(episode.alias("episode_id"), F.col("event_type").alias("stream"), F.lit("value").alias("channel"), (F.row_number().over(w) - 1).cast("bigint").alias("row_idx"), micros("ts").alias("native"), F.col("value").alias("v"))
    return rows.select("episode_id", "stream", "channel", "row_idx", "native", (F.col("native") / 1e6).alias("t"), "v")


def event_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views are certified, purchases irregular, the unit of errors is unknown."""
    s = table(spark, sf_dir, "events").select(F.concat(F.lit("ep"), F.col("user_id") % 8).alias("episode_id"), F.col("event_type").alias("stream")).distinct()
    kind = F.col("stream")
    return s.select(
        "*",
        F.concat(F.lit("proprio."), kind).alias("taxonomy"),
        F.lit("us").alias("unit"),
        F.when(kind == "error", F.lit(None)).otherwise(F.lit(1e-6)).cast("double").alias("scale"),
        (kind != "purchase").alias("regular"),
        kind.isin("click", "view").alias("certified"),
        F.lit(True).alias("ordered"),
    )


EVENTS = """
samples AS (SELECT 'ep' || (user_id % 8) AS episode_id, event_type AS stream, 'value' AS channel,
    row_number() OVER (PARTITION BY user_id % 8, event_type ORDER BY ts, event_id) - 1 AS row_idx,
    epoch_us(ts) AS native, epoch_us(ts) / 1e6 AS t, value AS v FROM events),
streams AS (SELECT DISTINCT episode_id, stream, 'proprio.' || stream AS taxonomy, CASE WHEN stream = 'error' THEN NULL ELSE 1e-6 END AS scale,
    stream <> 'purchase' AS regular, stream IN ('click', 'view') AS certified, TRUE AS ordered FROM samples)"""

_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def arm_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen episodes of three streams at 100 Hz, made of order lines: torque, velocity and gripper; chunk parts an episode by ranges of its order."""
    li = table(spark, sf_dir, "lineitem").withColumn("episode_id", F.concat(F.lit("arm"), F.col("l_suppkey") % 16))
    placed = numbered(li.select("episode_id", *_LINE, "l_discount"), ["episode_id"], list(_LINE), "row_idx")
    rows = placed.select("episode_id", "chunk", "row_idx", (F.col("l_quantity") - 25).alias("q"), (F.col("l_extendedprice") / 1000).alias("p"), F.col("l_discount").alias("d"))
    made = F.array(
        F.struct(F.lit("torque").alias("stream"), F.lit("x").alias("channel"), F.col("q").alias("v")),
        F.struct(F.lit("torque").alias("stream"), F.lit("y").alias("channel"), F.col("p").alias("v")),
        F.struct(F.lit("velocity").alias("stream"), F.lit("x").alias("channel"), F.col("p").alias("v")),
        F.struct(F.lit("velocity").alias("stream"), F.lit("y").alias("channel"), F.col("d").alias("v")),
        F.struct(F.lit("gripper").alias("stream"), F.lit("open").alias("channel"), F.when(F.col("q") > 0, 1.0).otherwise(0.0).alias("v")),
    )
    long = rows.select("episode_id", "chunk", "row_idx", F.explode(made).alias("m"))
    return long.select("episode_id", "m.stream", "m.channel", "chunk", "row_idx", (F.col("row_idx") * 10000).alias("native"), (F.col("row_idx") / 100).alias("t"), "m.v")


def arm_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arm_parts(spark, sf_dir).drop("chunk")


def arm_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("arm"), F.col("l_suppkey") % 16).alias("episode_id")).distinct()
    s = li.select("episode_id", F.explode(F.array(F.lit("torque"), F.lit("velocity"), F.lit("gripper"))).alias("stream"))
    return s.select("*", F.concat(F.lit("proprio."), F.col("stream")).alias("taxonomy"), F.lit("us").alias("unit"), F.lit(1e-6).alias("scale"), F.lit(True).alias("regular"), F.lit(True).alias("certified"), F.lit(True).alias("ordered"))


ARM = f"""
line AS (SELECT 'arm' || (l_suppkey % 16) AS episode_id, row_number() OVER (PARTITION BY l_suppkey % 16 ORDER BY {", ".join(_LINE)}) - 1 AS row_idx,
    l_quantity - 25 AS q, l_extendedprice / 1000 AS p, l_discount AS d FROM lineitem),
samples AS (SELECT episode_id, m.stream, m.channel, row_idx, row_idx * 10000 AS native, row_idx / 100.0::DOUBLE AS t, m.v FROM (
    SELECT episode_id, row_idx, unnest([{{'stream': 'torque', 'channel': 'x', 'v': q}}, {{'stream': 'torque', 'channel': 'y', 'v': p}},
      {{'stream': 'velocity', 'channel': 'x', 'v': p}}, {{'stream': 'velocity', 'channel': 'y', 'v': d}},
      {{'stream': 'gripper', 'channel': 'open', 'v': CASE WHEN q > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END}}]) AS m FROM line)),
streams AS (SELECT DISTINCT episode_id, stream, 'proprio.' || stream AS taxonomy, 1e-6 AS scale, TRUE AS regular, TRUE AS certified, TRUE AS ordered FROM samples)"""


def taxel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as tactile frames: an episode for each label, a frame for each vector, a cell for each dimension; eight cells are rounded away."""
    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = e.select(F.concat(F.lit("touch"), F.col("label")).alias("episode_id"), (F.row_number().over(w) - 1).cast("bigint").alias("row_idx"), "embedding")
    long = rows.select("episode_id", "row_idx", F.posexplode("embedding").alias("pos", "x"))
    v = F.when(F.col("pos") < 8, F.lit(0.5)).otherwise(F.col("x").cast("double"))
    return long.select("episode_id", F.lit("taxel").alias("stream"), F.concat(F.lit("c"), F.col("pos")).alias("channel"), "row_idx", (F.col("row_idx") * 20000).alias("native"), (F.col("row_idx") / 50).alias("t"), v.alias("v"))


TAXEL = """
frame AS (SELECT 'touch' || label AS episode_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_idx, embedding FROM embeddings),
samples AS (SELECT episode_id, 'taxel' AS stream, 'c' || (pos - 1) AS channel, row_idx, row_idx * 20000 AS native, row_idx / 50.0::DOUBLE AS t,
    CASE WHEN pos <= 8 THEN 0.5::DOUBLE ELSE embedding[pos]::DOUBLE END AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS pos FROM frame))"""


def quaternion_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four dimensions of each vector as a unit quaternion."""
    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    x = [F.get("embedding", F.lit(k)).cast("double") for k in range(4)]
    norm = F.sqrt(sum((c * c for c in x), F.lit(0.0)))
    parts = F.array(*[F.struct(F.lit(n).alias("channel"), (c / norm).alias("v")) for n, c in zip(("qx", "qy", "qz", "qw"), x, strict=True)])
    rows = e.select(F.concat(F.lit("turn"), F.col("label")).alias("episode_id"), (F.row_number().over(w) - 1).cast("bigint").alias("row_idx"), parts.alias("parts")).select("episode_id", "row_idx", F.explode("parts").alias("m"))
    return rows.select("episode_id", F.lit("pose").alias("stream"), "m.channel", "row_idx", (F.col("row_idx") * 10000).alias("native"), (F.col("row_idx") / 100).alias("t"), "m.v")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; -0 becomes 0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
