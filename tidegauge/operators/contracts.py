"""Schema and annotation: what a dataset declares against what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import first_reason, results
from .registry import metric

FAMILIES = {"int": T.IntegralType, "float": T.FractionalType, "str": T.StringType, "bool": T.BooleanType}


def type_family(kind: T.DataType) -> str:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return next((n for n, k in FAMILIES.items() if isinstance(kind, k)), kind.simpleString().lower())


def declared_family(name: str) -> str:
    n = name.lower()
    return "int" if n.startswith(("int", "uint")) else "float" if n.startswith(("float", "double")) else "str" if n.startswith("str") else n


def schema_mismatches(data: DataFrame, declared: dict[str, str]) -> list[tuple[str, str]]:
    """(feature, what is wrong): missing, or of another family of types."""
    found = {f.name: f.dataType for f in data.schema}
    out = []
    for name, kind in declared.items():
        if name not in found:
            out.append((name, "missing"))
        elif type_family(found[name]) != declared_family(kind):
            out.append((name, "type"))
    return out


@metric("feature_mismatch_count", level="episode", family="schema", unit="features")
def feature_mismatch_count(episodes: DataFrame, data: DataFrame, declared: dict[str, str]) -> DataFrame:
    return results(episodes, ("episode_id",), "feature_mismatch_count", "features", F.lit(float(len(schema_mismatches(data, declared)))), F.lit(None).cast("string"))


@metric("episode_file_mismatch", level="episode", family="schema", unit="flag")
def episode_file_mismatch(index: DataFrame, rows: DataFrame) -> DataFrame:
    """1 if the file that the index names holds none of the episode's rows; index: episode_id, file; rows: episode_id, file."""
    here = rows.select("episode_id", "file").distinct().withColumn("found", F.lit(True))
    out = index.join(here, ["episode_id", "file"], "left")
    return results(out, ("episode_id",), "episode_file_mismatch", "flag", F.col("found").isNull().cast("double"), first_reason((F.col("file").isNull(), "no file is named")))


@metric("episode_not_in_metadata", level="episode", family="schema", unit="flag")
def episode_not_in_metadata(index: DataFrame, rows: DataFrame) -> DataFrame:
    known = index.select("episode_id").distinct().withColumn("known", F.lit(True))
    out = rows.select("episode_id").distinct().join(known, "episode_id", "full_outer")
    return results(out, ("episode_id",), "episode_not_in_metadata", "flag", F.col("known").isNull().cast("double"), F.lit(None).cast("string"))


@metric("index_range_mismatch_count", level="episode", family="schema", unit="fields")
def index_range_mismatch_count(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Of from, to and length, those that the rows contradict; index: episode_id, from_index, to_index, length; rows: episode_id, index."""
    found = rows.groupBy("episode_id").agg(F.min("index").alias("lo"), (F.max("index") + 1).alias("hi"), F.count("*").alias("n"))
    out = index.join(found, "episode_id", "left")
    wrong = lambda a, b: (F.col(a).isNotNull() & (F.col(a) != F.col(b))).cast("double")
    total = wrong("from_index", "lo") + wrong("to_index", "hi") + wrong("length", "n")
    return results(out, ("episode_id",), "index_range_mismatch_count", "fields", total, first_reason((F.col("n").isNull(), "no rows")))


@metric("task_instruction_missing", level="episode", family="annotation", unit="flag")
def task_instruction_missing(episodes: DataFrame) -> DataFrame:
    """episodes: episode_id, tasks.  Not applicable where no episode of the dataset has a task."""
    has = F.exists(F.coalesce("tasks", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    rows = episodes.select("episode_id", F.coalesce(has, F.lit(False)).alias("has"))
    some = not rows.where("has").isEmpty()
    return results(rows, ("episode_id",), "task_instruction_missing", "flag", (~F.col("has")).cast("double"), first_reason((F.lit(not some), "the dataset has no tasks")))
