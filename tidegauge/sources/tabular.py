"""Delimited text, JSON lines and JSON documents as samples.

The schema is inferred from a table's columns: which is time and in which unit,
which names the entity, which are signals.  Every guess has a confidence; a
table without a time axis is refused and not guessed at.
"""

from __future__ import annotations

import csv
import json
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import UNIT_END, normalised
from ..model import SAMPLES
from .walk import adapter, head, listing, within_limits

ROW = "_row_idx"
# Factors to seconds, and the names that speak for a time axis or an entity.
FACTORS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
TIME_NAME = re.compile(r"(?i)(^|_)(t|ts|time|timestamp|stamp)(_|$|\b)")
ENTITY_NAME = re.compile(r"(?i)(^|_)(id|device|sensor|robot|arm|entity|name|serial)(_|$|\b)")
ACCEPT_TIME, ACCEPT_ENTITY = 0.6, 0.5


class UnresolvedSource(ValueError):
    """A source whose meaning can't be told."""


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    header: bool
    confidence: float


@dataclass(frozen=True)
class TableSchema:
    time: str
    unit: str | None
    entity: str | None
    signals: tuple[str, ...]
    confidence: float
    evidence: dict = field(default_factory=dict)


def sniff(text: str) -> Dialect:
    try:
        d = csv.Sniffer().sniff(text, delimiters=",;\t|")
        return Dialect(d.delimiter, csv.Sniffer().has_header(text), 0.9)
    except csv.Error:
        first = text.split("\n", 1)[0]
        return Dialect(",", not any(re.fullmatch(r"[-+.\deE]+", x.strip()) for x in first.split(",")), 0.3)


def _json_lines(start: bytes) -> int:
    n = 0
    for line in start.decode(errors="replace").split("\n")[:3]:
        try:
            n += isinstance(json.loads(line), dict)
        except ValueError:
            pass
    return n


def _bid_csv(spark: SparkSession, path: str, start: bytes) -> float:
    line = start.decode(errors="replace").split("\n", 1)[0]
    return 0.3 if path.lower().endswith(".csv") and any(len(line.split(d)) > 1 for d in ",;\t|") else 0.0


def _bid_jsonl(spark: SparkSession, path: str, start: bytes) -> float:
    return 0.5 if _json_lines(start) >= 2 else 0.0


def _bid_json(spark: SparkSession, path: str, start: bytes) -> float:
    return 0.4 if path.lower().endswith(".json") and _json_lines(start) < 2 and start.lstrip()[:1] in (b"{", b"[") else 0.0


def _bid_delimited(spark: SparkSession, path: str, start: bytes) -> float:
    rows = [r.split() for r in start.decode(errors="replace").split("\n")[:20] if r.strip() and not r.startswith("#")]
    numeric = [r for r in rows if len(r) > 1 and all(re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|nan|inf", x, re.I) for x in r)]
    return 0.2 if not path.lower().endswith((".csv", ".json")) and len(numeric) >= 2 and len(numeric) >= len(rows) - 1 else 0.0


def with_row_index(df: DataFrame) -> DataFrame:
    """Rows numbered in the file's order: partitions follow it, and their sizes give each one's first number."""
    marked = df.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    sizes = {r[0]: r[1] for r in marked.groupBy("_p").count().collect()}  # a number for each partition
    first, total = {}, 0
    for p in sorted(sizes):
        first[p] = total
        total += sizes[p]
    if not first:
        return df.withColumn(ROW, F.lit(0).cast("bigint"))
    starts = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    base = F.shiftleft(F.col("_p").cast("bigint"), 33)
    return marked.withColumn(ROW, F.col("_m") - base + starts[F.col("_p")]).drop("_p", "_m")


@adapter("csv", _bid_csv)
def read_csv(spark: SparkSession, path: str) -> DataFrame:
    d = sniff(head(spark, path).decode(errors="replace"))
    return with_row_index(spark.read.csv(path, sep=d.delimiter, header=d.header, inferSchema=True))


@adapter("delimited", _bid_delimited)
def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """White space between fields; names from the last comment before the data; a column is numeric only if all its values are."""
    lines = head(spark, path).decode(errors="replace").split("\n")
    comments, data = [], None
    for line in lines:
        if line.startswith("#"):
            comments.append(line.lstrip("# ").split())
        elif line.strip():
            data = line.split()
            break
    if data is None:
        raise UnresolvedSource(f"{path}: no rows")
    names = comments[-1] if comments and len(comments[-1]) == len(data) else [f"column_{i}" for i in range(len(data))]
    text = with_row_index(spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')"))
    parts = text.select(ROW, F.split(F.trim("value"), r"\s+").alias("f"))
    raw = parts.select(ROW, *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    bad = raw.agg(*[F.sum((F.col(n).isNotNull() & F.expr(f"try_cast(`{n}` AS double)").isNull()).cast("int")).alias(n) for n in names]).first()
    return raw.select(ROW, *[F.col(n) if bad[n] else F.col(n).cast("double").alias(n) for n in names])


def flattened(df: DataFrame) -> DataFrame:
    """Structs as dotted columns, arrays of numbers as one column for each place, other arrays as JSON text."""
    while True:
        out, more = [], False
        for f in df.schema:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StructType):
                out += [c[g.name].alias(f"{f.name}.{g.name}") for g in f.dataType]
                more = True
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
                n = df.select(F.max(F.size(c))).first()[0] or 0
                out += [F.get(c, F.lit(i)).alias(f"{f.name}_{i}") for i in range(n)]
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.to_json(c).alias(f.name))
            else:
                out.append(c)
        df = df.select(*out)
        if not more:
            return df


@adapter("jsonl", _bid_jsonl)
def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return flattened(with_row_index(spark.read.json(path)))


@adapter("json", _bid_json)
def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list or one record; or a dict of records, whose keys may end in a time, with a level of devices."""
    text = spark.read.text(path, wholetext=True)
    kind = text.select(F.substring(F.ltrim("value"), 1, 1)).first()[0]
    nested = "map<string,map<string,map<string,double>>>"
    keyed = text.select(F.from_json("value", nested).alias("m")).select(F.explode("m").alias("key", "devices")) if kind == "{" else None
    if keyed is not None and not (rows := keyed.select("key", F.explode("devices").alias("device_id", "fields")).where("size(fields) > 0")).isEmpty():
        from ..functions.names import timestamp_of_key

        names = [r[0] for r in rows.select(F.explode(F.map_keys("fields"))).distinct().orderBy("col").collect()]
        out = rows.select(timestamp_of_key(F.col("key")).cast("double").alias("timestamp_s"), "device_id", *[F.col("fields")[n].alias(n) for n in names])
        w = Window.partitionBy("device_id").orderBy("timestamp_s")
        return out.withColumn(ROW, (F.row_number().over(w) - 1).cast("bigint"))
    return flattened(with_row_index(spark.read.json(path, multiLine=True)))


#: Rows that one task orders in a table without an entity.
STRETCH = 1 << 20


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.name != ROW and isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def infer(df: DataFrame) -> TableSchema:
    """The schema of a table of rows with ``_row_idx``: two aggregations over all columns."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    entity, best = None, 0.0
    if texts:
        r = df.agg(F.count("*").alias("_n"), *[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in texts]).first()
        for c in texts:
            score = 0.4 * bool(ENTITY_NAME.search(c)) + 0.6 * (1 - r[c] / max(1, r["_n"]))
            if score >= ACCEPT_ENTITY and score > best:
                entity, best = c, score
    numbers = _numeric(df)
    if not numbers:
        raise UnresolvedSource("no numeric columns")
    # without an entity rows are ordered in stretches, each of which has the last row before it for its first step
    part, lead = F.floor(F.col(ROW) / STRETCH), (F.col(ROW) + 1) % STRETCH == 0
    parts = F.array(F.struct(part.alias("part"), F.lit(False).alias("lead")))
    parts = F.when(lead, F.concat(parts, F.array(F.struct((part + 1).alias("part"), F.lit(True).alias("lead"))))).otherwise(parts)
    rows = df.select("*", F.lit(False).alias("_lead")) if entity else df.select("*", F.explode(parts).alias("_p")).select("*", F.col("_p.lead").alias("_lead"))
    w = Window.partitionBy(F.col(f"`{entity}`") if entity else F.col("_p.part")).orderBy(ROW)
    steps = rows.select("_lead", *[(F.col(f"`{c}`").cast("double") - F.lag(F.col(f"`{c}`").cast("double")).over(w)).alias(c) for c in numbers]).where("NOT _lead")
    stats = steps.agg(*[F.avg((F.col(f"`{c}`") >= 0).cast("double")).alias(f"up{i}") for i, c in enumerate(numbers)], *[F.median(F.when(F.col(f"`{c}`") > 0, F.col(f"`{c}`"))).alias(f"gap{i}") for i, c in enumerate(numbers)]).first()
    found = []
    for i, c in enumerate(numbers):
        if stats[f"up{i}"] is None or stats[f"gap{i}"] is None:
            continue
        score = 0.45 * bool(TIME_NAME.search(c)) + 0.55 * stats[f"up{i}"]
        named = re.search(UNIT_END, c.lower())
        gap = stats[f"gap{i}"]
        size = "s" if gap < 1 else "ms" if gap < 1e3 else "us" if gap < 1e6 else "ns"
        named_unit = re.sub("sec$", "s", named.group(1)) if named else None
        score *= 1.0 if named_unit == size else 0.8 if named_unit else 0.9
        found.append((score, -i, c, size))
    best_time = max(found, default=(0.0, 0, None, None))
    if best_time[0] < ACCEPT_TIME:
        raise UnresolvedSource("no time axis")
    signals = tuple(c for c in numbers if c != best_time[2])
    return TableSchema(best_time[2], best_time[3], entity, signals, round(best_time[0], 3), {"entity_score": round(best, 3)})


def to_samples(df: DataFrame, schema: TableSchema, episode_id: str) -> DataFrame:
    """Columns to rows: streams by the stem of names and the entity, channels by column."""
    factor = FACTORS[schema.unit]
    key = F.coalesce(F.col(f"`{schema.entity}`").cast("string"), F.lit("unattributed")) if schema.entity else F.lit(None).cast("string")
    made = F.array(*[F.struct(F.lit(normalised(c)).alias("stem"), F.lit(c).alias("channel"), F.col(f"`{c}`").cast("double").alias("v")) for c in schema.signals])
    long = df.select(F.col(ROW).alias("row_idx"), F.col(f"`{schema.time}`").alias("raw"), key.alias("entity"), F.explode(made).alias("m"))
    stream = F.concat("m.stem", F.when(F.col("entity").isNotNull(), F.concat(F.lit("["), "entity", F.lit("]"))).otherwise(F.lit("")))
    return long.select(F.lit(episode_id).alias("episode_id"), stream.alias("stream"), "m.channel", "row_idx", F.round(F.col("raw") * factor * 1e9).cast("bigint").alias("native"), (F.col("raw") * factor).alias("t"), "m.v")


def read(spark: SparkSession, path: str, episode_id: str | None = None) -> DataFrame:
    """Samples of one file by the adapter that is surest of it; the episode is named after the file if not given."""
    from .walk import select

    a = select(spark, path)
    if a is None:
        raise UnresolvedSource(f"{path}: no adapter reads it")
    df = a.read(spark, path)
    return to_samples(df, infer(df), episode_id or path.rsplit("/", 1)[-1])


def read_folder(spark: SparkSession, root: str, max_bytes: int = 20_000_000_000, max_files: int = 10_000, workers: int = 8) -> tuple[DataFrame, DataFrame]:
    """Samples of all files below a folder, and (path, reason) of those that hold none.

    Each file is inferred by itself and is an episode named by its path below the
    root.  The plan has a branch for each file: what is too large for the limits
    is refused, and belongs in a Parquet tree, which is read as one table.
    """
    from .walk import AmbiguousSource

    files = listing(spark, root)
    fits, n, size = within_limits(files, max_bytes, max_files)
    if not fits:
        raise UnresolvedSource(f"{root}: {n} files of {size} bytes are beyond the limits")
    found = files.collect()  # bounded by max_files
    top = _top(spark, root)

    def one(f):
        name = f.path.removeprefix(top)
        if f.state != "candidate":
            return name, None, f.state
        try:
            return name, read(spark, f.path, name), None
        except (UnresolvedSource, AmbiguousSource) as x:
            return name, None, str(x)

    with ThreadPoolExecutor(workers) as pool:
        read_files = list(pool.map(one, found))
    parts = [df for _, df, _ in read_files if df is not None]
    samples = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SAMPLES)
    return samples, spark.createDataFrame([(name, why) for name, df, why in read_files if df is None], "path string, reason string")


def _top(spark: SparkSession, root: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getPath().toString().rstrip("/") + "/"
