"""From names to taxonomy types, axes and groups.

A dictionary is a small table that the caller may give as a file; all lookups
are expressions or joins with tables made of it.
"""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import AXES, UNITS, collapse, last_segment, normalised

UNMAPPED = "unmapped."


@dataclass(frozen=True)
class Pattern:
    """Globs on a feature's and a channel's name."""

    features: tuple[str, ...]
    names: tuple[str, ...]
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Entry:
    taxonomy: str
    aliases: tuple[str, ...] = ()
    namespaces: tuple[str, ...] = ()
    patterns: tuple[Pattern, ...] = ()


# Names under which the streams of the motion and tactile metrics are known.
DEFAULT = (
    Entry(
        "proprio.joint_position",
        ("arm_joints", "joint_angles", "joint_position", "joint_positions", "position", "q", "qpos", "robot0_joint_pos", "sensor_msgs/msg/JointState"),
        patterns=(Pattern(("observation.state", "observation.state.*", "state"), ("*.pos",), ("*finger*", "*hand*")),),
    ),
    Entry("proprio.joint_velocity", ("dq", "joint_vel", "joint_velocities", "joint_velocity", "observation.velocity", "qvel", "robot0_joint_vel", "velocity")),
    Entry("proprio.joint_acceleration", ("ddq", "joint_acceleration", "qacc")),
    Entry("proprio.joint_torque", ("effort", "joint_torque", "observation.effort", "qfrc_actuator", "tau_J", "torques")),
    Entry("extero.taxel_pressure", ("pressure_map", "tac_data", "tactile_readings", "taxel_array", "taxel_pressure", "touch_sensor")),
)


def read_dictionary(path: str) -> tuple[Entry, ...]:
    """Entries of a YAML file: taxonomy to aliases, namespace_aliases and channel_patterns."""
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    out = []
    for name, e in (raw.get("entries") or raw).items():
        patterns = tuple(Pattern(tuple(p.get("features", ())), tuple(p.get("names", ())), tuple(p.get("exclude", ()))) for p in e.get("channel_patterns", ()))
        out.append(Entry(name, tuple(e.get("aliases", ())), tuple(e.get("namespace_aliases", ())), patterns))
    return tuple(out)


def stem(name: Column) -> Column:
    """The last dotted segment, collapsed, without trailing axes and units; the whole where nothing else would be left."""
    return F.regexp_replace(collapse(last_segment(name)), f"^(.+?)(?:_(?:{'|'.join(AXES + UNITS)}))+$", "$1")


def alias_table(spark: SparkSession, entries: tuple[Entry, ...] = DEFAULT) -> DataFrame:
    """(kind, stem, claimants): the types that claim each stem, as a name or as an enclosing segment."""
    claims: dict[tuple[str, str], list[str]] = {}
    for e in entries:
        for kind, names in (("name", (*e.aliases, e.taxonomy.rsplit(".", 1)[-1])), ("namespace", e.namespaces)):
            for n in names:
                found = claims.setdefault((kind, normalised(n)), [])
                if e.taxonomy not in found:
                    found.append(e.taxonomy)
    return spark.createDataFrame([(*k, v) for k, v in claims.items()], "kind string, stem string, claimants array<string>")


def resolve_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per distinct name: stem, taxonomy (null if none or several claim it) and the candidates of an ambiguous one.

    The last segment decides; only if nobody claims it, the nearest enclosing
    segment that an entry lists as a namespace.  A null name has no row.
    """
    distinct = names.select("name").where("name IS NOT NULL").distinct().withColumn("stem", stem(F.col("name")))
    by = lambda kind: F.broadcast(aliases.where(F.col("kind") == kind).select(F.col("stem").alias("_stem"), "claimants"))
    own = distinct.join(by("name"), F.col("stem") == F.col("_stem"), "left").drop("_stem")
    parts = F.split("name", r"\.")
    above = own.where("claimants IS NULL").select("name", F.posexplode(F.slice(F.reverse(parts), 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("far", "segment"))
    near = above.withColumn("_own", stem(F.col("segment"))).join(by("namespace"), F.col("_own") == F.col("_stem"))
    near = near.groupBy("name").agg(F.min(F.struct("far", F.col("_own").alias("stem"), "claimants")).alias("n"))
    out = own.join(near, "name", "left").withColumns({"claimants": F.coalesce("claimants", "n.claimants"), "stem": F.coalesce("n.stem", "stem")})
    one = F.size("claimants") == 1
    return out.select("name", "stem", F.when(one, F.get("claimants", F.lit(0))).alias("taxonomy"), F.when(one | F.col("claimants").isNull(), F.array().cast("array<string>")).otherwise(F.col("claimants")).alias("candidates"))


def roles(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """resolve_names with the axis and the unit that the name ends in, and how sure the type is: 1, or 0 for unmapped and ambiguous."""
    rows = resolve_names(names, aliases)
    end = F.element_at(F.split(collapse(last_segment(F.col("name"))), "_"), -1)
    has_stem = end != collapse(last_segment(F.col("name")))
    axis = F.when(has_stem & (end.isin(*AXES) | end.rlike("^[0-9]+$")), end)
    unit = F.when(has_stem & end.isin(*[u for u in UNITS if u not in AXES]), end)
    return rows.select("*", axis.alias("axis"), unit.alias("unit"), F.when(F.col("taxonomy").isNotNull(), 1.0).otherwise(0.0).alias("confidence"))


def match_channel(feature: Column, name: Column, entries: tuple[Entry, ...] = DEFAULT) -> Column:
    """The one type whose globs match feature and name; null for none, several or no feature.  An expression: no join."""
    like = lambda c, globs: F.lower(c).rlike("|".join(fnmatch.translate(g.lower()).replace(r"\Z", "$").replace(r"\z", "$") for g in globs)) if globs else F.lit(False)
    hits = []
    for e in entries:
        if e.patterns:
            any_ = F.lit(False)
            for p in e.patterns:
                any_ = any_ | (like(feature, p.features) & like(name, p.names) & ~like(name, p.exclude))
            hits.append(F.when(any_, F.lit(e.taxonomy)))
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def resolve_feature(key: str, declared: list[str], lookup: dict[str, str | None]) -> str:
    """A declared feature's type: by its key, else the one type that all its declared names have, else unmapped."""
    if found := lookup.get(key):
        return found
    types = {lookup.get(n) for n in declared}
    if len(types) == 1 and (one := types.pop()):
        return one
    return UNMAPPED + key


def preferred_type(claims: DataFrame, ranks: tuple[str, ...] = ("argument", "file", "bundle", "sidecar", "declared", "inferred")) -> DataFrame:
    """Per feature the type of the strongest source that names one; two types of one source are a conflict, and then there is none.

    claims: feature, source, taxonomy.
    """
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col("source"))
    rows = claims.where("taxonomy IS NOT NULL").withColumn("rank", rank).where("rank > 0")
    best = rows.withColumn("_first", F.min("rank").over(Window.partitionBy("feature"))).where("rank = _first")
    out = best.groupBy("feature").agg(F.first("source").alias("source"), F.count_distinct("taxonomy").alias("types"), F.min("taxonomy").alias("taxonomy"))
    return out.select("feature", "source", F.when(F.col("types") == 1, F.col("taxonomy")).alias("taxonomy"), (F.col("types") > 1).alias("conflict"))


def asserted(channels: DataFrame, assertions: DataFrame) -> DataFrame:
    """Channels with the taxonomy asserted for their feature, index and source (any source if null); two assertions for one are an error.

    channels: feature, index, source; assertions: those and taxonomy.
    """
    a = assertions.select(F.col("feature").alias("_f"), F.col("index").alias("_i"), F.col("source").alias("_s"), F.col("taxonomy").alias("asserted"))
    meets = (F.col("feature") == F.col("_f")) & (F.col("index") == F.col("_i")) & (F.col("_s").isNull() | (F.col("source") == F.col("_s")))
    found = channels.join(a, meets, "left").groupBy("feature", "index", "source").agg(F.count("asserted").alias("n"), F.first("asserted", ignorenulls=True).alias("asserted"))
    twice = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("more than one assertion matches "), F.col("feature")))).otherwise(F.col("asserted"))
    return found.select("feature", "index", "source", twice.cast("string").alias("asserted"))


def camera_key(field: Column, kind: Column, instance: Column) -> Column:
    """The source field, else type[instance], else the type."""
    return F.coalesce(field, F.when(instance.isNotNull(), F.concat(kind, F.lit("["), instance, F.lit("]"))), kind)


def qualified_episode(source: Column, episode: Column, whole_file: Column) -> Column:
    """The source alone for a recording that is a whole file, else source::episode."""
    return F.when(whole_file | episode.isNull(), source).otherwise(F.concat(source, F.lit("::"), episode))


# -- columns of one file: lists of names, not data


def axis_of(name: str) -> str | None:
    """A bare axis letter."""
    return name.lower() if name.lower() in AXES else None


def without_lone_w(axes: dict[str, str | None]) -> dict[str, str | None]:
    """w is an axis only beside x, y or z; alone it is as often watts."""
    return axes if {"x", "y", "z"} & set(axes.values()) else {k: None if a == "w" else a for k, a in axes.items()}


def grouped_by_stem(columns: list[str], file_stem: str) -> dict[str, list[str]]:
    """Columns under their stems, in order of first sight; bare axes go under the file's stem."""
    bare = without_lone_w({c: axis_of(c) for c in columns})
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(file_stem if bare[c] else normalised(c) or c, []).append(c)
    return out


def axes_of(columns: list[str], *, array: bool = False) -> dict[str, str | None]:
    """The axis of each column of a group; places 0 to 2 or 3 of an array that holds axes are x, y, z and w."""
    ends = {c: axis_of(c) or (e if (e := c.lower().replace(".", "_").rsplit("_", 1)[-1]) != c.lower() and (e in AXES or e.isdigit()) else None) for c in columns}
    if array and set(ends.values()) in ({"0", "1", "2"}, {"0", "1", "2", "3"}):
        ends = {c: AXES[int(e)] for c, e in ends.items()}
    return without_lone_w(ends)


def ordered_by_axis(columns: list[str], axes: dict[str, str | None]) -> list[str]:
    """x, y, z, w first, then numbers, then the rest as they came."""

    def place(c: str) -> tuple[int, int]:
        a = axes.get(c)
        return (0, AXES.index(a)) if a in AXES else (1, int(a)) if a and a.isdigit() else (2, 0)

    return sorted(columns, key=place)


def is_quaternion(names: list[str]) -> bool:
    """Exactly one each of qx, qy, qz and qw."""
    ends = [n.lower().replace(".", "_").rsplit("_", 1)[-1] for n in names]
    return sorted(ends) == ["qw", "qx", "qy", "qz"]


def task_list(value) -> list[str]:
    """Strings of a task field, however it is nested; nulls are left out."""
    if value is None:
        return []
    if isinstance(value, bytes):
        return [value.decode(errors="replace")]
    if isinstance(value, (list, tuple, set)) or hasattr(value, "tolist"):
        return [t for x in (value.tolist() if hasattr(value, "tolist") else value) for t in task_list(x)]
    return [str(value)]


def declared_names(value) -> list[str]:
    """Names of a feature's declaration: a list, lists of lists, or a dictionary of lists under any key."""
    if isinstance(value, dict):
        return [n for v in value.values() for n in declared_names(v)]
    return task_list(value)
