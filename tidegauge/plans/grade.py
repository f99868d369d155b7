"""The library's entry: read, measure, score and decide; and comparing two gradings."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import dictionary as D
from ..operators import gates as G
from ..operators import integrity, motion, timing  # noqa: F401
from ..operators.registry import METRICS
from ..operators.timing import regularity
from . import eligibility as E
from . import policy as P
from . import scoring as S

SIGNAL_FAMILIES = ("timing", "integrity", "motion")


@dataclass(frozen=True)
class Grading:
    """A grading's tables; none is computed before it is asked for."""

    results: DataFrame
    findings: DataFrame
    scores: DataFrame
    decisions: DataFrame
    coverage: DataFrame

    def write(self, path: str) -> None:
        """Each table under a folder; the suffix chooses the format (.json, .csv, else Parquet)."""
        kind = path.rsplit(".", 1)[-1].lower()
        for name in TABLES:
            df = getattr(self, name)
            writer = df.write.mode("overwrite")
            (writer.json if kind == "json" else writer.option("header", True).csv if kind == "csv" else writer.parquet)(f"{path}/{name}")

    def card(self, most: int = 10) -> str:
        """A short text: the verdict first, then the worst findings."""
        counts = {r.decision: r["count"] for r in self.decisions.groupBy("decision").count().collect()}
        worst = S.sort_findings(self.findings).limit(most).collect()
        lines = ["  ".join(f"{d} {counts.get(d, 0)}" for d in ("pass", "review", "unknown", "blocked"))]
        return "\n".join([*lines, *(f"{r.severity:8} {r.episode_id} {r.finding_key}: {r.value:.4g}" for r in worst)])


def grade_samples(
    samples: DataFrame,
    streams: DataFrame,
    policy: tuple[P.Grade, ...] = P.DEFAULT,
    metrics: tuple[str, ...] | None = None,
    targets: dict[str, float] | None = None,
    needed: E.Requirements | None = None,
    capabilities: dict[str, tuple[str, ...]] | None = None,
    extra: DataFrame | None = None,
) -> Grading:
    """Grades recordings: every metric on the streams that meet its requirements.

    targets: what a metric is graded against where that is a deviation, by metric.
    needed: requirements that leave an episode unknown; capabilities: the metrics
    that each capability needs.  extra: results of whole episodes (contracts), whose
    episodes are decided even if they have no samples.
    """
    spark = samples.sparkSession
    parts = []
    for m in METRICS.values():
        if m.family in SIGNAL_FAMILIES and m.level in ("channel", "stream") and (metrics is None or m.name in metrics):
            r = m.run(samples, streams)
            parts.append(r if "channel" in r.columns else r.withColumn("channel", F.lit("")))
    results = G.gated(reduce(DataFrame.unionByName, parts), G.requirements(spark), streams, G.stream_sizes(samples))
    results = results.join(streams.select("episode_id", "stream", "taxonomy"), ["episode_id", "stream"], "left")
    target = F.lit(None).cast("double")
    for name, value in (targets or {}).items():
        target = F.when(F.col("metric") == name, float(value)).otherwise(target)
    stuck = integrity.flatline_evidence(samples).select("episode_id", "stream", "channel", F.lit("flatline_pct").alias("metric"), "never_changed")
    results = results.withColumn("target", target).join(stuck, ["episode_id", "stream", "channel", "metric"], "left")
    if extra is not None:
        whole = extra.withColumns({"stream": F.lit(""), "channel": F.lit("")})
        results = results.unionByName(whole, allowMissingColumns=True)
    resolved = S.resolve(results, P.grades_table(spark, policy), P.bands_table(spark, policy))
    found = S.findings(resolved)
    scores = S.episode_scores(S.family_scores(S.metric_rollup(resolved)))
    episodes = samples.select("episode_id").distinct()
    if extra is not None:
        episodes = episodes.union(extra.select("episode_id")).distinct()
    reasons = None
    if needed is not None:
        table = spark.createDataFrame([(c, m) for c, names in (capabilities or {}).items() for m in names], "capability string, metric string")
        payload = streams.join(G.stream_sizes(samples), ["episode_id", "stream"], "left").withColumn("payload", F.when(F.col("rows") > 0, "computed").otherwise("missing"))
        reasons = E.requirement_reasons(episodes, resolved, payload, E.episode_ledger(results, table), needed)
    return Grading(resolved, found, scores, S.decisions(episodes, found, reasons), S.coverage(results))


def inferred_streams(samples: DataFrame, entries: tuple[D.Entry, ...] = D.DEFAULT, certified: bool = False) -> DataFrame:
    """Streams of a table that declares nothing: typed by their names, regular by their gaps, in nanoseconds; not certified unless said so."""
    base = samples.select("episode_id", "stream").distinct().withColumns({"scale": F.lit(1e-9), "ordered": F.lit(True)})
    known = regularity(samples, base).select("episode_id", "stream", "regular")
    named = D.resolve_names(base.select(F.col("stream").alias("name")), D.alias_table(samples.sparkSession, entries)).select(F.col("name").alias("stream"), F.col("taxonomy").alias("type"))
    rows = base.join(known, ["episode_id", "stream"], "left").join(named, "stream", "left")
    return rows.select("episode_id", "stream", F.coalesce("type", F.concat(F.lit(D.UNMAPPED), "stream")).alias("taxonomy"), F.lit("ns").alias("unit"), "scale", F.coalesce("regular", F.lit(False)).alias("regular"), F.lit(certified).alias("certified"), "ordered")


def contract_results(spark: SparkSession, root: str) -> DataFrame:
    """What a tree's index and declared features say against its rows, for each episode of either side."""
    from ..sources import lerobot

    data, index = lerobot.data(spark, root), lerobot.index_rows(spark, root)
    rows = data.select(F.col("episode_index").cast("string").alias("episode_id"), "index")
    parts = [C.episode_not_in_metadata(index, rows), C.index_range_mismatch_count(index, rows), C.task_instruction_missing(index)]
    declared = lerobot.declared(spark, root)
    if declared:
        parts.append(C.feature_mismatch_count(index, data, declared))
    return reduce(DataFrame.unionByName, parts)


def grade(spark: SparkSession, path: str, policy: tuple[P.Grade, ...] = P.DEFAULT, **options) -> Grading:
    """Grades what lies at a path; options: those of grade_samples.

    A file is read by the adapter that is surest of it, a folder file by file, each
    an episode.  A tree of episodes is read as one table and graded with its contracts; its clock
    is certified unless stamps are just frame numbers over the declared rate.
    """
    from ..sources import lerobot, tabular, walk

    kind = walk.kind(spark, path)
    if kind == "tree":
        samples, fps = lerobot.samples(spark, path), lerobot.info(spark, path).get("fps")
        certified = bool(fps) and not lerobot.reconstructed_clock(lerobot.data(spark, path), float(fps))
        return grade_samples(samples, inferred_streams(samples, certified=certified), policy, extra=contract_results(spark, path), **options)
    samples = tabular.read(spark, path) if kind == "file" else tabular.read_folder(spark, path)[0]
    return grade_samples(samples, inferred_streams(samples), policy, **options)


TABLES = ("results", "findings", "scores", "decisions", "coverage")


def load(spark: SparkSession, path: str) -> Grading:
    """A grading that ``write`` left as Parquet; the text formats don't keep types and are not read again."""
    return Grading(*[spark.read.parquet(f"{path}/{t}") for t in TABLES])


def disagreements(g: Grading) -> DataFrame:
    """(rule, episode_id, address) where a grading's tables contradict each other; empty for a sound one."""
    keys = ["episode_id", "stream", "channel", "metric"]
    at = F.concat_ws("/", "stream", "channel", "metric").alias("address")
    flagged = g.results.where("status IN ('warning', 'critical')")
    none = F.lit("").alias("address")

    def broken(rule: str, rows: DataFrame, address=none) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), "episode_id", address)

    blocking = g.findings.where("consequence = 'block'").select("episode_id").distinct()
    found = [
        broken("a finding without its result", g.findings.join(flagged, keys, "left_anti"), at),
        broken("a flagged result without its finding", flagged.join(g.findings, keys, "left_anti"), at),
        broken("a value beside a reason", g.results.where("value IS NOT NULL AND reason IS NOT NULL"), at),
        broken("points out of range", g.results.where("points < 0 OR points > 100"), at),
        broken("a score out of range", g.scores.where("score < 0 OR score > 100")),
        broken("an episode decided twice", g.decisions.groupBy("episode_id").count().where("count > 1")),
        broken("a score without a decision", g.scores.join(g.decisions, "episode_id", "left_anti")),
        broken("a blocking finding, not blocked", g.decisions.where("decision <> 'blocked'").join(blocking, "episode_id", "left_semi")),
    ]
    return reduce(DataFrame.unionByName, found)


def compare(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("episode_id", "stream", "channel", "metric")) -> DataFrame:
    """Results of two gradings by address: added, removed, changed or same; an address that is not unique is an error."""
    for side in (old, new):
        twice = side.groupBy(*keys).count().where("count > 1")
        if not twice.isEmpty():
            raise ValueError(f"ambiguous address: {twice.first().asDict()}")
    a, b = (s.select(*keys, F.col("value").alias(n), F.col("status").alias(f"{n}_status"), F.lit(True).alias(f"in_{n}")) for s, n in ((old, "old"), (new, "new")))
    both = a.join(b, list(keys), "full_outer")
    same = F.col("old").eqNullSafe(F.col("new")) & F.col("old_status").eqNullSafe(F.col("new_status"))
    return both.select(*keys, "old", "new", "old_status", "new_status", F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(same, "same").otherwise("changed").alias("state"))


def exit_code(decisions: DataFrame, fail_on: str = "blocked") -> int:
    """0 if all is well, 1 if an episode is as bad as fail_on or worse, 2 if there are none."""
    order = ("blocked", "unknown", "review", "pass")
    counts = {r.decision: r["count"] for r in decisions.groupBy("decision").count().collect()}
    if not counts:
        return 2
    return int(any(counts.get(d) for d in order[: order.index(fail_on) + 1]))


def without_defaults(record: dict) -> dict:
    """Empty values left out, at every depth."""
    out = {}
    for k, v in record.items():
        v = without_defaults(v) if isinstance(v, dict) else v
        if v not in (None, "", [], {}):
            out[k] = v
    return out


def aliases(records: list[dict]) -> dict[str, str]:
    """Short names for keys, the most frequent first."""
    from collections import Counter

    counts: Counter = Counter()

    def walk(x) -> None:
        if isinstance(x, dict):
            counts.update(x.keys())
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(records)
    return {k: f"k{i:x}" for i, (k, _) in enumerate(sorted(counts.items(), key=lambda c: (-c[1], c[0])))}


def compact_json(records: list[dict]) -> str:
    """Records with aliased keys, and the table to read them by."""
    names = aliases(records)

    def short(x):
        if isinstance(x, dict):
            return {names[k]: short(v) for k, v in x.items()}
        return [short(v) for v in x] if isinstance(x, list) else x

    return json.dumps({"keys": {v: k for k, v in names.items()}, "records": short(records)}, separators=(",", ":"), sort_keys=True)


def read_compact(text: str) -> list[dict]:
    raw = json.loads(text)

    def long(x):
        if isinstance(x, dict):
            return {raw["keys"][k]: long(v) for k, v in x.items()}
        return [long(v) for v in x] if isinstance(x, list) else x

    return long(raw["records"])
