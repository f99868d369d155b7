"""What keeps an episode from passing besides its findings: requirements, scopes, calibration; and the tables a report lists."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.places import bounds, range_of
from .policy import Grade

VIDEO = ("video_quality", "sampled_video_quality")


@dataclass(frozen=True)
class Requirements:
    """What a pass needs under a scope."""

    families: tuple[str, ...] = ()
    capabilities: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    payloads: bool = False
    bindings: bool = False


REASON = ("episode_id", "id", "kind", "detail")


def _lines(rows: DataFrame, id_: Column, kind: str, detail: Column) -> DataFrame:
    return rows.select("episode_id", id_.alias("id"), F.lit(kind).alias("kind"), detail.alias("detail"))


def _missing(episodes: DataFrame, names: tuple[str, ...], have: DataFrame, word: str, ending: str) -> DataFrame:
    """A reason for each name that an episode has no row of; have: episode_id, name."""
    grid = episodes.withColumn("name", F.explode(F.array(*map(F.lit, sorted(names)))))
    lack = grid.join(have.select("episode_id", "name").distinct(), ["episode_id", "name"], "left_anti")
    return _lines(lack, F.concat(F.lit(f"{word}:"), "name"), "requirement", F.concat(F.lit(f"required {word} "), "name", F.lit(f" {ending}")))


def requirement_reasons(episodes: DataFrame, resolved: DataFrame, streams: DataFrame, ledger: DataFrame, needed: Requirements) -> DataFrame:
    """(episode_id, id, kind, detail): all that leaves an episode unknown, whatever its findings.

    resolved: episode_id, metric, family, points; streams: episode_id, stream,
    taxonomy, payload (computed, missing, skipped or error); ledger: episode_id,
    kind (capability or metric), name, eligible, computed, error.
    """
    episodes = episodes.select("episode_id").distinct()
    graded = resolved.where("points IS NOT NULL")
    none = episodes.join(graded.select("episode_id").distinct(), "episode_id", "left_anti")
    out = [_lines(none, F.lit("graded_result"), "requirement", F.lit("no metric produced a graded result"))]
    if needed.families:
        out.append(_missing(episodes, needed.families, graded.select("episode_id", F.col("family").alias("name")), "family", "graded no result"))
    if needed.payloads:
        bad = streams.where("payload IN ('missing', 'skipped', 'error')")
        out.append(_lines(bad, F.concat(F.lit("payload:"), "taxonomy"), "requirement", F.concat(F.lit("stream "), "taxonomy", F.lit(" payload "), "payload")))
    if needed.bindings:
        bad = streams.where("taxonomy IS NULL OR taxonomy LIKE 'unmapped%'")
        name = F.coalesce("taxonomy", "stream")
        out.append(_lines(bad, F.concat(F.lit("binding:"), name), "binding", F.concat(F.lit("stream "), name, F.lit(" is not bound"))))
    whole = ledger.where("eligible > 0 AND computed = eligible")
    failed = ledger.where("error > 0").select("episode_id").distinct()
    out.append(_lines(failed, F.lit("analysis_error"), "requirement", F.lit("analysis met an error")))
    caps = tuple({*needed.capabilities, *(("numeric",) if needed.payloads else ())})
    for kind, names in (("capability", caps), ("metric", needed.metrics)):
        if names:
            out.append(_missing(episodes, names, whole.where(F.col("kind") == kind), kind, "was not fully evaluated"))
    return reduce(DataFrame.unionByName, out).distinct()


def scoped(policy: tuple[Grade, ...], needed: Requirements, overrides: dict[str, dict[str, dict]] | None = None, everywhere: tuple[str, ...] = ()) -> tuple[Grade, ...]:
    """The policy under a scope: overrides by capability, and vision only reported where the scope asks for no video quality.

    overrides: capability to metric to changes; everywhere: vision metrics graded in every scope.
    """
    known = {g.metric: g for g in policy}
    for capability, changes in (overrides or {}).items():
        if capability in needed.capabilities:
            for name, change in changes.items():
                known[name] = replace(known[name], **change)
    sees = any(c in needed.capabilities for c in VIDEO)
    return tuple(g if sees or g.family != "vision" or g.metric in everywhere else replace(g, report_only=True) for g in known.values())


def declared_targets(sources: dict[str, str], info: dict) -> dict[str, float]:
    """Targets by metric from what a dataset declares: numbers only, a missing one is left out."""
    found = {m: info.get(name) for m, name in sources.items()}
    return {m: float(v) for m, v in found.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}


def calibrated(findings: DataFrame, manifests: DataFrame, statistical: tuple[str, ...]) -> DataFrame:
    """Findings with an id; a critical one of a statistical metric blocks only under an accepted manifest, else it is for review.

    manifests: metric, taxonomy, accepted, reason, at most one row for both.  The
    signal-to-noise metrics also need a noise assessment above their reference
    (column noise_above, null: none).
    """
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("episode_id", "stream", "channel", "metric")])
    rows = findings.join(F.broadcast(manifests.select("metric", "taxonomy", F.col("accepted").alias("_ok"), F.col("reason").alias("_why"))), ["metric", "taxonomy"], "left")
    mine = F.col("metric").isin(*statistical) & (F.col("severity") == "critical")
    noisy = F.col("metric").isin("snr_db", "rotation_snr_db") & ~F.coalesce("noise_above", F.lit(False))
    ok = F.coalesce("_ok", F.lit(False)) & ~noisy
    why = F.when(noisy, "no noise assessment above its reference").otherwise(F.coalesce("_why", F.lit("no manifest")))
    return rows.select(
        *[c for c in findings.columns if c != "consequence"],
        F.sha2(key, 256).alias("id"),
        F.when(mine, F.when(ok, "block").otherwise("review")).otherwise(F.col("consequence")).alias("consequence"),
        F.when(mine, F.when(ok, "statistical").otherwise("heuristic")).alias("evidence_strength"),
        F.when(mine & ~ok, why).alias("calibration_reason"),
    )


def episode_ledger(results: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(episode_id, kind, name, eligible, computed, error) for metrics and for capabilities.

    capabilities: capability and the metrics it needs.  A result that does not
    apply isn't eligible; a capability is computed on an episode where all its
    eligible results are.
    """
    state = F.col("availability")
    n = lambda c: F.sum(c.cast("int"))
    per = results.groupBy("episode_id", "metric").agg(n(state != "not_applicable").alias("eligible"), n(state == "computed").alias("computed"), n(state == "error").alias("error"))
    metrics = per.select("episode_id", F.lit("metric").alias("kind"), F.col("metric").alias("name"), "eligible", "computed", "error")
    caps = per.join(F.broadcast(capabilities), "metric").groupBy("episode_id", "capability").agg(F.sum("eligible").alias("eligible"), F.sum("computed").alias("computed"), F.sum("error").alias("error"))
    return metrics.unionByName(caps.select("episode_id", F.lit("capability").alias("kind"), F.col("capability").alias("name"), "eligible", "computed", "error"))


def dataset_ledger(ledger: DataFrame) -> DataFrame:
    """Ledgers of episodes as one of the dataset, with the episodes that are wholly evaluated."""
    whole = (F.col("eligible") > 0) & (F.col("computed") == F.col("eligible"))
    return ledger.groupBy("kind", "name").agg(*[F.sum(c).alias(c) for c in ("eligible", "computed", "error")], F.sum(whole.cast("int")).alias("whole"), F.count("*").alias("episodes"))


def reason_codes(rows: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(rows with ``code`` for their reason, table of code and reason); codes run from 1 in the order of the texts, null stays null.

    Reasons are few, so the ordering window holds distinct texts only.
    """
    table = rows.where(F.col(reason).isNotNull()).select(reason).distinct().withColumn("code", F.row_number().over(Window.orderBy(reason)))
    return rows.join(F.broadcast(table), reason, "left").drop(reason), table.select("code", reason)


def shared_findings(findings: DataFrame, clocks: DataFrame) -> DataFrame:
    """Findings of one clock with equal metric, value and evidence as one, with the streams that share it.

    clocks: episode_id, stream, clock; a stream without one is its own.
    """
    rows = findings.join(clocks, ["episode_id", "stream"], "left").withColumn("clock", F.coalesce("clock", "stream"))
    found = rows.groupBy("episode_id", "clock", "metric", "value", "evidence").agg(F.sort_array(F.collect_set("stream")).alias("streams"))
    return found.select("episode_id", "metric", "value", "evidence", F.get("streams", F.lit(0)).alias("stream"), F.array_join(F.slice("streams", 2, 1 << 30), ",").alias("shared_by"))


def flagged_rows(resolved: DataFrame) -> DataFrame:
    """Metrics that flagged subjects: numbers of warnings and criticals and the worst points, worst first by ``place``."""
    bad = resolved.where("status IN ('warning', 'critical')")
    n = lambda s: F.sum((F.col("status") == s).cast("int"))
    rows = bad.groupBy("metric").agg(n("critical").alias("criticals"), n("warning").alias("warnings"), F.min("points").alias("worst"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("criticals"), F.desc("warnings"), "metric")))


def finding_groups(findings: DataFrame) -> DataFrame:
    """Findings by metric and severity, with the episodes they are on."""
    return findings.groupBy("metric", "severity").agg(F.count("*").alias("findings"), F.count_distinct("episode_id").alias("episodes"))


def episode_extent(samples: DataFrame) -> DataFrame:
    """Per episode the time from its first to its last sample and the rows of its longest stream."""
    each = samples.groupBy("episode_id", "stream").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count_distinct("row_idx").alias("n"))
    return each.groupBy("episode_id").agg((F.max("b") - F.min("a")).alias("seconds"), F.max("n").alias("rows"))


def critical_keys(findings: DataFrame) -> DataFrame:
    """Per episode the keys of its blocking findings, sorted."""
    return findings.where("consequence = 'block'").groupBy("episode_id").agg(F.array_join(F.sort_array(F.collect_set("finding_key")), ",").alias("finding_keys"))


def strided(episodes: DataFrame, order: str, sample: int) -> DataFrame:
    """``sample`` episodes at most, evenly strided over their order; ranges of the order are numbered each by itself, and only those with one of the places."""
    n = episodes.count()
    step = max(1, n // max(1, sample))
    rows = episodes.withColumn("_c", range_of(F.col(order), bounds(episodes, order), episodes.schema[order].dataType))
    start, wanted = 0, {}
    for r in sorted(rows.groupBy("_c").count().collect()):
        first = -(-start // step) * step
        if first < min(start + r["count"], step * sample):
            wanted[r["_c"]] = start
        start += r["count"]
    if not wanted:
        return episodes.limit(0)
    before = F.element_at(F.create_map(*[F.lit(x) for c, k in wanted.items() for x in (c, k)]), F.col("_c"))
    rows = rows.where(F.col("_c").isin(list(wanted))).withColumn("_k", before + F.row_number().over(Window.partitionBy("_c").orderBy(order)) - 1)
    return rows.where((F.col("_k") % step == 0) & (F.col("_k") < step * sample)).drop("_k", "_c")


def overlap(tuning: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    """Sessions that both sides hold; there must be none."""
    return tuning.select(key).distinct().join(validation.select(key).distinct(), key, "left_semi")


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place of their first sight."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first"))


def graded_match(diagnostic: DataFrame, graded: DataFrame) -> DataFrame:
    """Diagnostic streams with the graded stream of the same field, instance and path; nulls match nulls."""
    g = graded.select(*[F.col(c).alias(f"_{c}") for c in ("field", "instance", "path")], "status")
    on = F.lit(True)
    for c in ("field", "instance", "path"):
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return diagnostic.join(g, on, "left").drop("_field", "_instance", "_path")


def review_findings(diagnostics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Diagnostic values over their limits as findings for review; diagnostics: episode_id, name, value."""
    limit = F.lit(None).cast("double")
    for name, most in limits.items():
        limit = F.when(F.col("name") == name, float(most)).otherwise(limit)
    rows = diagnostics.withColumn("threshold", limit).where(F.col("value") > F.col("threshold"))
    return rows.select("episode_id", F.concat(F.lit("diagnostic."), "name").alias("metric"), "value", "threshold", F.lit("review").alias("consequence"))


def window_sufficiency(decided: DataFrame, windows: DataFrame, least: int) -> DataFrame:
    """Passing windows of passing episodes against the number that is needed; windows: episode_id, passing."""
    rows = decided.where("decision = 'pass'").join(windows, "episode_id")
    return rows.agg(F.coalesce(F.sum("passing"), F.lit(0)).alias("windows"), F.lit(least).alias("required")).withColumn("sufficient", F.col("windows") >= F.col("required"))


def resolved_windows(windows: DataFrame, decided: DataFrame) -> DataFrame:
    """Windows after the decisions: one on a blocked episode is blocked, a pending one takes its episode's decision, others stay."""
    d = F.col("decision")
    state = F.when(d == "blocked", "blocked").when(F.col("state") == "pending", F.coalesce(d, F.lit("unknown"))).otherwise(F.col("state"))
    return windows.join(decided.select("episode_id", "decision"), "episode_id", "left").withColumn("state", state).drop("decision")


def report_warnings(gaps: DataFrame) -> DataFrame:
    """One line of text for each kind of warning: kind, episodes.  gaps: kind, episode_id."""
    text = {"instruction": "have no task instruction", "corrupt": "hold corrupt footage", "swap": "hold another camera's footage", "viewpoint": "come after a change of view"}
    said = F.lit("need a look")
    for kind, words in text.items():
        said = F.when(F.col("kind") == kind, words).otherwise(said)
    n = gaps.groupBy("kind").agg(F.count_distinct("episode_id").alias("episodes"))
    return n.select("kind", "episodes", F.concat_ws(" ", F.col("episodes").cast("string"), F.when(F.col("episodes") == 1, "episode").otherwise("episodes"), said).alias("text"))
