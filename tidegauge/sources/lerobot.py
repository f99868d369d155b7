"""Trees of episodes in Parquet: one file an episode (2.x), or many in a file with an index (3.0)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .walk import head

INDEX = ("timestamp", "frame_index", "episode_index", "index", "task_index")


def info(spark: SparkSession, root: str) -> dict:
    return json.loads(head(spark, f"{root}/meta/info.json", 1 << 24).decode())


def checked_template(template: str, known: tuple[str, ...]) -> str:
    """A path template; one that names an unknown field is refused."""
    for name in re.findall(r"{(\w+)", template):
        if name not in known:
            raise ValueError(f"path template names {name!r}")
    return template


def data(spark: SparkSession, root: str) -> DataFrame:
    """All rows with the file they came from; Spark prunes columns and files."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")
    return df.withColumn("source", F.col("_metadata.file_path"))


def episode_index(spark: SparkSession, root: str) -> DataFrame:
    """The index of a 3.0 tree, or what meta/episodes.jsonl of a 2.x tree says."""
    if str(info(spark, root).get("codebase_version", "v2.0")).lstrip("v").startswith("3"):
        return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes")
    return spark.read.schema("episode_index bigint, tasks array<string>, length bigint").json(f"{root}/meta/episodes.jsonl")


def index_rows(spark: SparkSession, root: str) -> DataFrame:
    """The index as contracts ask for it: episode_id, tasks, length, from_index, to_index; null where the tree doesn't say."""
    index = episode_index(spark, root)
    wanted = {"tasks": ("tasks", "array<string>"), "length": ("length", "bigint"), "from_index": ("dataset_from_index", "bigint"), "to_index": ("dataset_to_index", "bigint")}
    cols = [(F.col(c) if c in index.columns else F.lit(None)).cast(t).alias(n) for n, (c, t) in wanted.items()]
    return index.select(F.col("episode_index").cast("string").alias("episode_id"), *cols)


def declared(spark: SparkSession, root: str) -> dict[str, str]:
    """The declared type of each feature that has a column; images and videos lie elsewhere."""
    features = info(spark, root).get("features") or {}
    return {n: str(f["dtype"]) for n, f in features.items() if isinstance(f, dict) and f.get("dtype") not in (None, "image", "video")}


def episodes(spark: SparkSession, root: str) -> DataFrame:
    """Every episode of either side: rows, whether listed, length; and so the orphans of both."""
    rows = data(spark, root).groupBy("episode_index").agg(F.count("*").alias("rows"), F.min("index").alias("lo"), (F.max("index") + 1).alias("hi"), F.count_distinct("source").alias("files"))
    index = episode_index(spark, root).select("episode_index", "length").withColumn("listed", F.lit(True))
    return rows.join(index, "episode_index", "full_outer").withColumn("state", F.when(F.col("listed").isNull(), "not in metadata").when(F.col("rows").isNull(), "no rows").otherwise("found"))


def chunk_of(index, size: int):
    return F.floor(index / size).cast("bigint")


def reconstructed_clock(df: DataFrame, fps: float, epsilon: float = 1e-4) -> bool:
    """Whether stamps are just frame numbers over the rate."""
    worst = df.agg(F.max(F.abs(F.col("timestamp").cast("double") - F.col("frame_index") / fps))).first()[0]
    return worst is not None and worst <= epsilon


def samples(spark: SparkSession, root: str) -> DataFrame:
    """Lists become channels by place, scalars a channel of their own."""
    df = data(spark, root)
    parts = []
    for f in df.schema:
        kind = f.dataType
        if f.name in (*INDEX, "source"):
            continue
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
            parts.append(_array(f.name))
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            parts.append(F.array(F.struct(F.lit(f.name).alias("stream"), F.lit(f.name).alias("channel"), F.col(f"`{f.name}`").cast("double").alias("v"))))
    rows = df.select(F.col("episode_index").cast("string").alias("episode_id"), F.col("frame_index").cast("bigint").alias("row_idx"), F.col("timestamp").cast("double").alias("t"), F.explode(F.concat(*parts)).alias("m"))
    return rows.select("episode_id", "m.stream", "m.channel", "row_idx", F.round(F.col("t") * 1e9).cast("bigint").alias("native"), "t", "m.v")


def _array(name: str):
    return F.transform(F.col(f"`{name}`"), lambda x, i: F.struct(F.lit(name).alias("stream"), F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")).alias("channel"), x.cast("double").alias("v")))
