"""Listing a folder through Spark's file systems, and choosing who reads what."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length and state (candidate, empty, hidden) of every file below a root, in order of paths; nothing is opened."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.getFileStatus(p).getPath().toString().rstrip("/") + "/"
    found, rows = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        path, size = f.getPath().toString(), f.getLen()
        hidden = any(x.startswith(".") for x in path.removeprefix(top).split("/"))
        rows.append((path, size, "hidden" if hidden else "candidate" if size else "empty"))
    return spark.createDataFrame(sorted(rows), "path string, length bigint, state string")


def kind(spark: SparkSession, path: str) -> str:
    """What lies at a path: ``tree`` (a folder with meta/info.json), ``folder`` or ``file``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(p).isDirectory():
        return "file"
    return "tree" if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "meta/info.json")) else "folder"


def within_limits(files: DataFrame, max_bytes: int = 20_000_000_000, max_files: int = 10_000) -> tuple[bool, int, int]:
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return n <= max_files and size <= max_bytes, n, size


def head(spark: SparkSession, path: str, size: int = 8192) -> bytes:
    """The first bytes of a file on any file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    n = min(size, fs.getFileStatus(p).getLen())
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


@dataclass(frozen=True)
class Adapter:
    """A reader of recordings: how sure it is of a file (0 to 1), and its reading."""

    name: str
    detect: Callable[[SparkSession, str, bytes], float]
    read: Callable[..., DataFrame]


ADAPTERS: dict[str, Adapter] = {}


def adapter(name: str, detect: Callable[[SparkSession, str, bytes], float]) -> Callable:
    def keep(read: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in ADAPTERS:
            raise ValueError(f"adapter {name!r} is registered twice")
        ADAPTERS[name] = Adapter(name, detect, read)
        return read

    return keep


class AmbiguousSource(ValueError):
    """Two adapters are equally sure of a file."""


def select(spark: SparkSession, path: str) -> Adapter | None:
    """The surest adapter; none if none bids; a tie at the top is an error."""
    start = head(spark, path)
    bids = sorted(((a.detect(spark, path, start), a.name) for a in ADAPTERS.values()), reverse=True)
    best = [b for b in bids if b[0] > 0 and b[0] == bids[0][0]]
    if len(best) > 1:
        raise AmbiguousSource(f"{path}: {', '.join(n for _, n in best)}")
    return ADAPTERS[best[0][1]] if best else None


def load_plugins(group: str = "tidegauge.adapters") -> list[str]:
    """Adapters of installed packages; a package that fails is left out and named."""
    from importlib.metadata import entry_points

    failed = []
    for e in entry_points(group=group):
        try:
            e.load()
        except Exception as x:  # noqa: BLE001
            failed.append(f"{e.name}: {x}")
    return failed
