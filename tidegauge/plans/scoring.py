"""From results to points, scores, findings, coverage and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import finite
from .policy import CAPS, FAMILY_WEIGHTS, LETTERS, LOW_SCORE, TRAIT_EPISODES

SUBJECT = ("episode_id", "stream", "channel")


def band_points(value: Column, good: Column, bad: Column) -> Column:
    """100 at good or beyond, 0 at bad or beyond, linear between; good may be the greater."""
    share = (value - bad) / (good - bad)
    return 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def reduced(value: Column, target: Column, reduction: Column) -> Column:
    """The graded quantity: the value, or its relative deviation from a target."""
    return F.when(reduction == "abs_dev", F.abs(value - target) / F.abs(target)).otherwise(value)


def status_of(points: Column) -> Column:
    return F.when(points >= 100, "good").when(points <= 0, "critical").otherwise("warning")


def letter(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(LETTERS):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def cap_letter(share: Column) -> Column:
    out = F.lit(None).cast("string")
    for most, name in reversed(CAPS):
        out = F.when(share <= most, F.lit(name).cast("string")).otherwise(out)
    return out


def with_bands(results: DataFrame, grades: DataFrame, bands: DataFrame) -> DataFrame:
    """Results with their grading; the band of the taxonomy, if that row is there, overrides the default even with nulls."""
    own = F.broadcast(bands.select("metric", "taxonomy", F.col("good").alias("_g"), F.col("bad").alias("_b"), F.lit(True).alias("_own")))
    base = F.broadcast(bands.where("taxonomy = 'default'").select("metric", F.col("good").alias("_dg"), F.col("bad").alias("_db")))
    joined = results.join(F.broadcast(grades), "metric", "left").join(own, ["metric", "taxonomy"], "left").join(base, "metric", "left")
    return joined.withColumns({"good": F.when(F.col("_own"), F.col("_g")).otherwise(F.col("_dg")), "bad": F.when(F.col("_own"), F.col("_b")).otherwise(F.col("_db"))}).drop("_g", "_b", "_own", "_dg", "_db")


def resolve(results: DataFrame, grades: DataFrame, bands: DataFrame) -> DataFrame:
    """Adds points and status.

    results: subject keys, metric, taxonomy, value, reason; and if known target,
    never_changed, exempt (within its reference, or simulated).  The cases are in
    the order that counts.
    """
    for name, kind in (("target", "double"), ("never_changed", "boolean"), ("exempt", "boolean")):
        if name not in results.columns:
            results = results.withColumn(name, F.lit(None).cast(kind))
    rows = with_bands(results, grades, bands)
    missing = F.col("reason").isNotNull() | ~F.coalesce(finite(F.col("value")), F.lit(False))
    target = (F.col("reduction") == "abs_dev") & (F.col("target").isNull() | (F.col("target") == 0))
    only = F.coalesce("exempt", F.lit(False)) | F.col("family").isNull() | F.col("policy_report_only") | F.col("good").isNull() | F.col("bad").isNull() | target
    graded = ~missing & ~only
    points = band_points(reduced(F.col("value"), F.col("target"), F.col("reduction")), F.col("good"), F.col("bad"))
    stuck = F.coalesce("never_changed", F.lit(False)) & (points <= 0)
    points = F.when(graded, F.when(stuck, 50.0).otherwise(points))
    return rows.withColumn("points", points).withColumn("status", F.when(missing, "not_applicable").when(only, "report_only").otherwise(status_of(F.col("points"))))


def consequence(status: Column, contract: Column, metric: Column) -> Column:
    """Only a critical finding has one: a contract blocks; a statistical metric is for review."""
    snr = metric.isin("snr_db", "rotation_snr_db")
    return F.when(status == "critical", F.when(contract & ~snr, "block").otherwise("review"))


def findings(resolved: DataFrame) -> DataFrame:
    """Warnings and criticals as located findings."""
    keys = [k for k in SUBJECT if k in resolved.columns]
    rows = resolved.where("status IN ('warning', 'critical')")
    stream = F.col("stream") if "stream" in keys else F.lit(None).cast("string")
    channel = F.col("channel") if "channel" in keys else F.lit(None).cast("string")
    key = F.concat(F.coalesce(stream, F.lit("")), F.when(channel.isNotNull(), F.concat(F.lit("/"), channel)).otherwise(F.lit("")), F.lit("."), F.col("metric"))
    return rows.select(*keys, "metric", "value", "points", F.col("status").alias("severity"), consequence(F.col("status"), F.col("contract"), F.col("metric")).alias("consequence"), key.alias("finding_key"))


def sort_findings(found: DataFrame) -> DataFrame:
    """Critical first, then by points, then by place."""
    rank = F.when(F.col("severity") == "critical", 0).otherwise(1)
    return found.orderBy(rank, "points", "episode_id", "finding_key")


def metric_rollup(resolved: DataFrame) -> DataFrame:
    """Per episode and metric: the worst subject's points, graded and flagged subjects."""
    return resolved.groupBy("episode_id", "metric", "family", "weight", "core").agg(
        F.min("points").alias("points"), F.count("points").alias("n_graded"), F.sum(F.col("status").isin("warning", "critical").cast("int")).alias("n_flagged")
    )


def weighted_mean(points: Column, weight: Column) -> Column:
    """Sum(p * w) / sum(w) over graded rows, null if no weight is positive."""
    w = F.when(points.isNotNull(), weight)
    total = F.sum(w)
    return F.when(total > 0, F.sum(points * w) / total)


def family_scores(rollup: DataFrame) -> DataFrame:
    """Per episode and family; a family with a core metric counts only if one of them is graded."""
    core = F.bool_or(F.col("core"))
    core_graded = F.bool_or(F.col("core") & F.col("points").isNotNull())
    score = weighted_mean(F.col("points"), F.col("weight"))
    scored = rollup.where("family IS NOT NULL AND weight IS NOT NULL").groupBy("episode_id", "family").agg(score.alias("score"), core.alias("has_core"), core_graded.alias("core_graded"))
    return scored.select("episode_id", "family", F.when(F.col("core_graded") | ~F.col("has_core"), F.col("score")).alias("score"))


def episode_scores(families: DataFrame) -> DataFrame:
    """The mean of family scores by their weights, and its letter."""
    weight = F.lit(1.0)
    for name, w in FAMILY_WEIGHTS.items():
        weight = F.when(F.col("family") == name, w).otherwise(weight)
    out = families.groupBy("episode_id").agg(weighted_mean(F.col("score"), weight).alias("score"))
    return out.withColumn("letter", letter(F.col("score")))


def dataset_rollup(resolved: DataFrame) -> DataFrame:
    """Per metric: distinct subjects graded and flagged, episodes flagged."""
    keys = [k for k in SUBJECT if k in resolved.columns]
    subject = F.struct(*keys)
    flagged = F.col("status").isin("warning", "critical")
    return resolved.groupBy("metric").agg(
        F.count_distinct(F.when(F.col("points").isNotNull(), subject)).alias("n_graded"),
        F.count_distinct(F.when(flagged, subject)).alias("n_flagged"),
        F.count_distinct(F.when(flagged, F.col("episode_id"))).alias("episodes_flagged"),
    )


def family_tails(families: DataFrame, low: float = LOW_SCORE) -> DataFrame:
    return families.where("score IS NOT NULL").groupBy("family").agg(F.sum((F.col("score") < low).cast("int")).alias("n_low"), F.count("*").alias("n"), F.min("score").alias("min"))


def rollup_score(families: DataFrame) -> DataFrame:
    """The unweighted mean of episodes' family scores."""
    return families.groupBy("family").agg(F.avg("score").alias("score"))


def fail_penalty(score: Column, n_fail: Column, penalty: float, cap: float) -> Column:
    return F.greatest(F.lit(0.0), score - F.least(n_fail * penalty, F.lit(cap)))


def decisions(episodes: DataFrame, found: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """blocked before unknown before review before pass; an episode without any reason passes."""
    ranks = found.where("consequence IS NOT NULL").select("episode_id", F.when(F.col("consequence") == "block", 0).otherwise(2).alias("rank"))
    if reasons is not None:
        ranks = ranks.unionByName(reasons.select("episode_id", F.lit(1).alias("rank")))
    worst = ranks.groupBy("episode_id").agg(F.min("rank").alias("rank"), F.count("*").alias("n_reasons"))
    rank = F.coalesce("rank", F.lit(3))
    named = F.element_at(F.array(*map(F.lit, ("blocked", "unknown", "review", "pass"))), rank + 1)
    return episodes.select("episode_id").join(worst, "episode_id", "left").select("episode_id", named.alias("decision"), F.coalesce("n_reasons", F.lit(0)).cast("bigint").alias("n_reasons"))


def eligibility(decided: DataFrame, failed: int = 0, complete: bool = True) -> DataFrame:
    """Counts by decision; episodes that could not be read are unknown; the share only of a complete inventory."""
    n = lambda s: F.sum((F.col("decision") == s).cast("int"))
    out = decided.agg(F.count("*").alias("episodes"), n("pass").alias("passed"), n("review").alias("review"), (n("unknown") + failed).alias("unknown"), n("blocked").alias("blocked"))
    share = F.col("passed") / (F.col("episodes") + failed)
    ready = F.when(F.col("blocked") > 0, False).when((F.col("passed") == F.col("episodes") + failed) & F.lit(complete), True)
    return out.select("*", F.when(F.lit(complete), share).alias("pass_share"), ready.alias("train_ready"))


def readiness(decided: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of passing episodes over all episodes."""
    rows = decided.join(scores, "episode_id", "left")
    return rows.agg(F.count("*").alias("episodes"), (F.sum(F.when(F.col("decision") == "pass", F.col("score"))) / F.count("*")).alias("readiness"))


def sufficiency(decided: DataFrame, least: int) -> DataFrame:
    passed = F.sum((F.col("decision") == "pass").cast("int"))
    return decided.agg(passed.alias("passed"), F.lit(least).alias("required"), (passed >= least).alias("sufficient"))


def gate_counts(resolved: DataFrame) -> DataFrame:
    """Per episode and metric: graded, all, not applicable, and the first reason."""
    return resolved.groupBy("episode_id", "metric").agg(F.count("points").alias("graded"), F.count("*").alias("total"), F.sum((F.col("status") == "not_applicable").cast("int")).alias("not_applicable"), F.min("reason").alias("reason"))


def gate_coverage(counts: DataFrame, share: float = 0.5) -> DataFrame:
    """Metrics, the share of episodes on which they don't apply, and whether that is too many."""
    absent = F.avg((F.col("not_applicable") == F.col("total")).cast("double"))
    return counts.groupBy("metric").agg(absent.alias("absent_share"), F.median("graded").alias("median_graded")).withColumn("widespread", F.col("absent_share") >= share)


def dataset_traits(keys: DataFrame, episodes: int, share: float = 0.9) -> DataFrame:
    """Finding keys on nearly all episodes: a trait of the dataset and not of one recording."""
    import math

    return keys.groupBy("finding_key").agg(F.count_distinct("episode_id").alias("episodes")).where(F.col("episodes") >= math.ceil(share * episodes - 1e-9))


def task_traits(keys: DataFrame, tasks: DataFrame, least: int = TRAIT_EPISODES) -> DataFrame:
    """Keys on every episode of just one task, of so many episodes at least, and on no other's."""
    size = tasks.groupBy("task").agg(F.count_distinct("episode_id").alias("size")).where(F.col("size") >= least)
    found = keys.select("episode_id", "finding_key").distinct().join(tasks, "episode_id")
    each = found.groupBy("finding_key", "task").agg(F.count_distinct("episode_id").alias("n"))
    one = each.groupBy("finding_key").agg(F.count("*").alias("tasks"), F.first("task").alias("task"), F.first("n").alias("n")).where("tasks = 1")
    return one.join(size, "task").where("n = size").select("finding_key", "task", "n")


def gate(decided: DataFrame, scores: DataFrame) -> DataFrame:
    """The dataset's letter: its score's, capped by the share of episodes that fail."""
    rows = decided.join(scores, "episode_id", "left")
    out = rows.agg(F.avg((F.col("decision") == "blocked").cast("double")).alias("failing"), F.avg("score").alias("score"))
    return out.select("failing", "score", letter(F.col("score")).alias("scored"), cap_letter(F.col("failing")).alias("cap"), F.greatest(letter(F.col("score")), F.coalesce(cap_letter(F.col("failing")), F.lit("A"))).alias("letter"))


STATES = ("computed", "not_applicable", "unavailable", "skipped", "error", "not_required")


def coverage(results: DataFrame) -> DataFrame:
    """Per metric: subjects in each state, and reasons with their counts."""
    state = F.when(F.col("reason").isNotNull(), "not_applicable").otherwise("computed") if "availability" not in results.columns else F.col("availability")
    rows = results.withColumn("_state", state)
    counts = rows.groupBy("metric").agg(*[F.sum((F.col("_state") == s).cast("int")).alias(s) for s in STATES])
    reasons = rows.where("reason IS NOT NULL").groupBy("metric", "reason").agg(F.count("*").alias("n"))
    listed = reasons.groupBy("metric").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "reason", "n"))), "; ").alias("reasons"))
    return counts.join(listed, "metric", "left").fillna({"reasons": ""})


def merge_coverage(*ledgers: DataFrame) -> DataFrame:
    """Counters added by metric: associative, so ledgers of parts make the ledger of the whole."""
    out = ledgers[0]
    for x in ledgers[1:]:
        out = out.unionByName(x)
    return out.groupBy("metric").agg(*[F.sum(s).alias(s) for s in STATES])


def expected_coverage(metrics: list[str], subjects: DataFrame, results: DataFrame) -> DataFrame:
    """Every metric for every subject; what has no result is not applicable."""
    grid = subjects.withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    keys = [k for k in SUBJECT if k in subjects.columns]
    return grid.join(results, [*keys, "metric"], "left").withColumn("availability", F.coalesce("availability", F.lit("not_applicable")))


def worst_first(found: DataFrame, n: int) -> DataFrame:
    """The n worst findings of each episode."""
    w = Window.partitionBy("episode_id").orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), "points", "finding_key")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
