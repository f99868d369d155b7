"""Small helpers for Spark: reading tables, shared scratch space, SQL idioms."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@functools.cache
def _local() -> str:
    """A folder of this process, gone with it."""
    path = tempfile.mkdtemp(prefix="tidegauge-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir.

    Where that is unset, a folder of this process serves a session that runs in
    it, as in tests; on a cluster that is an error, for executors share no folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or _local()
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: lineage ends there and executors may go."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidegauge_path = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes a table that ``written`` made and that no frame reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tidegauge_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row, however often the body and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)
