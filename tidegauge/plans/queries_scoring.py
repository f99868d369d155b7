"""Queries of grading and decisions over the arm and event recordings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.integrity import flatline_pct, missing_pct, spike_pct
from ..operators.timing import drop_rate, monotonic_violations, recorded_hz
from . import datasets as D
from . import policy as P
from . import scoring as S
from .queries_metrics import SQL as METRIC_SQL


def _results(spark, sf_dir) -> DataFrame:
    """Channel and stream metrics of the event recordings as one table."""
    samples, streams = D.event_samples(spark, sf_dir), D.event_streams(spark, sf_dir)
    channel = [m(samples) for m in (flatline_pct, missing_pct, spike_pct)]
    stream = [m(samples, streams).withColumn("channel", F.lit("")) for m in (monotonic_violations, drop_rate, recorded_hz)]
    rows = reduce(DataFrame.unionByName, [*channel, *stream])
    return rows.withColumn("taxonomy", F.concat(F.lit("proprio."), "stream"))


#: Bands under which these recordings show every status.
POLICY = P.extended(
    P.DEFAULT,
    {
        "flatline_pct": {"good": 0.5, "bad": 1.5, "taxonomies": {"proprio.signup": (None, None)}},
        "spike_pct": {"good": 0.05, "bad": 0.8},
        "drop_rate": {"good": 0.2, "bad": 0.5},
        "monotonic_violations": {"contract": True},
    },
)


def _resolved(spark, sf_dir) -> DataFrame:
    return S.resolve(_results(spark, sf_dir), P.grades_table(spark, POLICY), P.bands_table(spark, POLICY))


def quality_results(spark, sf_dir):
    return D.rounded(_resolved(spark, sf_dir).select("episode_id", "stream", "channel", "metric", "value", "points", "status", "reason"))


def quality_findings(spark, sf_dir):
    return D.rounded(S.findings(_resolved(spark, sf_dir)))


def quality_rollup(spark, sf_dir):
    return D.rounded(S.metric_rollup(_resolved(spark, sf_dir)).select("episode_id", "metric", "points", "n_graded", "n_flagged"))


def _families(spark, sf_dir):
    return S.family_scores(S.metric_rollup(_resolved(spark, sf_dir)))


def quality_families(spark, sf_dir):
    return D.rounded(_families(spark, sf_dir))


def quality_scores(spark, sf_dir):
    return D.rounded(S.episode_scores(_families(spark, sf_dir)))


def quality_tails(spark, sf_dir):
    return D.rounded(S.family_tails(_families(spark, sf_dir), 95.0))


def quality_dataset(spark, sf_dir):
    return S.dataset_rollup(_resolved(spark, sf_dir))


def _decisions(spark, sf_dir):
    resolved = _resolved(spark, sf_dir)
    return S.decisions(resolved.select("episode_id").distinct(), S.findings(resolved))


def quality_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir)


def quality_eligibility(spark, sf_dir):
    return D.rounded(S.eligibility(_decisions(spark, sf_dir)))


def quality_readiness(spark, sf_dir):
    return D.rounded(S.readiness(_decisions(spark, sf_dir), S.episode_scores(_families(spark, sf_dir))))


def quality_gate(spark, sf_dir):
    return D.rounded(S.gate(_decisions(spark, sf_dir), S.episode_scores(_families(spark, sf_dir))))


def quality_coverage(spark, sf_dir):
    return S.coverage(_results(spark, sf_dir))


def gate_coverage(spark, sf_dir):
    return D.rounded(S.gate_coverage(S.gate_counts(_resolved(spark, sf_dir))))


def dataset_traits(spark, sf_dir):
    found = S.findings(_resolved(spark, sf_dir))
    return S.dataset_traits(found, 8, 0.5)


def task_traits(spark, sf_dir):
    """A task is an episode's parity."""
    found = S.findings(_resolved(spark, sf_dir))
    tasks = found.select("episode_id").distinct().withColumn("task", F.concat(F.lit("task"), F.substring("episode_id", 3, 9).cast("int") % 4))
    return S.task_traits(found, tasks, least=1)


def worst_findings(spark, sf_dir):
    return D.rounded(S.worst_first(S.findings(_resolved(spark, sf_dir)), 3).select("episode_id", "place", "finding_key", "points"))


def _part(name: str, channel: str) -> str:
    """The metric's SQL over the event recordings, unrounded."""
    return f"SELECT episode_id, stream, {channel} AS channel, '{name}' AS metric, value, reason FROM ({METRIC_SQL['metric_' + name].replace(D.ARM, D.EVENTS).replace('round(value, 6) + 0.0', 'value')})"


_GRADES = ", ".join(
    f"('{g.metric}', '{g.family}', {g.weight if g.weight is not None else 'NULL'}::DOUBLE, {g.good if g.good is not None else 'NULL'}::DOUBLE, {g.bad if g.bad is not None else 'NULL'}::DOUBLE, {g.core}, {g.report_only}, {g.contract}, '{g.reduction}')"
    for g in POLICY
)
_BASE = f"""WITH results AS ({" UNION ALL ".join([*[_part(n, "channel") for n in ("flatline_pct", "missing_pct", "spike_pct")], *[_part(n, "''") for n in ("monotonic_violations", "drop_rate", "recorded_hz")]])}),
grades(metric, family, weight, good, bad, core, ro, contract, reduction) AS (VALUES {_GRADES}),
banded AS (SELECT r.*, g.* EXCLUDE (metric, good, bad), CASE WHEN r.metric = 'flatline_pct' AND stream = 'signup' THEN NULL ELSE good END AS good,
    CASE WHEN r.metric = 'flatline_pct' AND stream = 'signup' THEN NULL ELSE bad END AS bad FROM results r LEFT JOIN grades g USING (metric)),
pointed AS (SELECT *, CASE WHEN reason IS NULL AND value IS NOT NULL AND NOT ro AND good IS NOT NULL AND bad IS NOT NULL AND reduction = 'value'
    THEN 100 * greatest(0, least(1, (value - bad) / (good - bad))) END AS points FROM banded),
resolved AS (SELECT *, CASE WHEN reason IS NOT NULL OR value IS NULL THEN 'not_applicable' WHEN points IS NULL THEN 'report_only' WHEN points >= 100 THEN 'good' WHEN points <= 0 THEN 'critical' ELSE 'warning' END AS status FROM pointed),
findings AS (SELECT episode_id, stream, channel, metric, value, points, status AS severity, CASE WHEN status = 'critical' THEN CASE WHEN contract THEN 'block' ELSE 'review' END END AS consequence,
    stream || '/' || channel || '.' || metric AS finding_key FROM resolved WHERE status IN ('warning', 'critical')),
rollup_ AS (SELECT episode_id, metric, family, weight, core, min(points) AS points, count(points) AS n_graded, count(*) FILTER (status IN ('warning', 'critical')) AS n_flagged FROM resolved GROUP BY ALL),
families AS (SELECT episode_id, family, CASE WHEN bool_or(core AND points IS NOT NULL) OR NOT bool_or(core) THEN sum(points * weight) / nullif(sum(weight) FILTER (points IS NOT NULL), 0) END AS score FROM rollup_ WHERE family IS NOT NULL AND weight IS NOT NULL GROUP BY ALL),
scores AS (SELECT episode_id, sum(score * w) / sum(w) FILTER (score IS NOT NULL) AS score FROM (SELECT *, CASE family WHEN 'integrity' THEN 3.0 WHEN 'timing' THEN 2.0 WHEN 'motion' THEN 2.0 WHEN 'vision' THEN 2.0 ELSE 1.0 END AS w FROM families) GROUP BY ALL),
lettered AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' WHEN score IS NOT NULL THEN 'F' END AS letter FROM scores),
decided AS (SELECT e.episode_id, CASE min(CASE consequence WHEN 'block' THEN 0 WHEN 'review' THEN 2 END) WHEN 0 THEN 'blocked' WHEN 2 THEN 'review' ELSE 'pass' END AS decision, count(consequence) AS n_reasons
    FROM (SELECT DISTINCT episode_id FROM resolved) e LEFT JOIN findings f ON e.episode_id = f.episode_id GROUP BY ALL)
"""

QUERIES = {
    f.__name__: f
    for f in (quality_results, quality_findings, quality_rollup, quality_families, quality_scores, quality_tails, quality_dataset, quality_decisions, quality_eligibility, quality_readiness, quality_gate, quality_coverage, gate_coverage, dataset_traits, task_traits, worst_findings)
}
SQL = {
    "quality_results": _BASE + "SELECT episode_id, stream, channel, metric, round(value, 6) AS value, round(points, 6) AS points, status, reason FROM resolved",
    "quality_findings": _BASE + "SELECT episode_id, stream, channel, metric, round(value, 6) AS value, round(points, 6) AS points, severity, consequence, finding_key FROM findings",
    "quality_rollup": _BASE + "SELECT episode_id, metric, round(points, 6) AS points, n_graded, n_flagged FROM rollup_",
    "quality_families": _BASE + "SELECT episode_id, family, round(score, 6) AS score FROM families",
    "quality_scores": _BASE + "SELECT episode_id, round(score, 6) AS score, letter FROM lettered",
    "quality_tails": _BASE + "SELECT family, count(*) FILTER (score < 95) AS n_low, count(*) AS n, round(min(score), 6) AS min FROM families WHERE score IS NOT NULL GROUP BY family",
    "quality_dataset": _BASE
    + """SELECT metric, count(DISTINCT (episode_id, stream, channel)) FILTER (points IS NOT NULL) AS n_graded, count(DISTINCT (episode_id, stream, channel)) FILTER (status IN ('warning', 'critical')) AS n_flagged,
    count(DISTINCT episode_id) FILTER (status IN ('warning', 'critical')) AS episodes_flagged FROM resolved GROUP BY metric""",
    "quality_decisions": _BASE + "SELECT episode_id, decision, n_reasons FROM decided",
    "quality_eligibility": _BASE
    + """SELECT count(*) AS episodes, count(*) FILTER (decision = 'pass') AS passed, count(*) FILTER (decision = 'review') AS review, count(*) FILTER (decision = 'unknown') AS unknown, count(*) FILTER (decision = 'blocked') AS blocked,
    round(count(*) FILTER (decision = 'pass') / count(*), 6) AS pass_share, CASE WHEN count(*) FILTER (decision = 'blocked') > 0 THEN FALSE WHEN count(*) FILTER (decision = 'pass') = count(*) THEN TRUE END AS train_ready FROM decided""",
    "quality_readiness": _BASE + "SELECT count(*) AS episodes, round(sum(score) FILTER (decision = 'pass') / count(*), 6) AS readiness FROM decided LEFT JOIN scores USING (episode_id)",
    "quality_gate": _BASE
    + """, g AS (SELECT avg(CASE WHEN decision = 'blocked' THEN 1.0 ELSE 0.0 END) AS failing, avg(score) AS score FROM decided LEFT JOIN scores USING (episode_id)),
h AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS scored, CASE WHEN failing <= 0.05 THEN NULL WHEN failing <= 0.15 THEN 'B' WHEN failing <= 0.3 THEN 'C' ELSE 'D' END AS cap FROM g)
SELECT round(failing, 6) AS failing, round(score, 6) AS score, scored, cap, greatest(scored, coalesce(cap, 'A')) AS letter FROM h""",
    "quality_coverage": _BASE
    + """, k AS (SELECT metric, reason || '=' || count(*) AS t FROM results WHERE reason IS NOT NULL GROUP BY metric, reason)
SELECT metric, count(*) FILTER (reason IS NULL) AS computed, count(*) FILTER (reason IS NOT NULL) AS not_applicable, 0 AS unavailable, 0 AS skipped, 0 AS error, 0 AS not_required,
    coalesce((SELECT string_agg(t, '; ' ORDER BY t) FROM k WHERE k.metric = r.metric), '') AS reasons FROM results r GROUP BY metric""",
    "gate_coverage": _BASE
    + """, c AS (SELECT episode_id, metric, count(points) AS graded, count(*) AS total, count(*) FILTER (status = 'not_applicable') AS na FROM resolved GROUP BY ALL)
SELECT metric, round(avg(CASE WHEN na = total THEN 1.0 ELSE 0.0 END), 6) AS absent_share, median(graded) AS median_graded, avg(CASE WHEN na = total THEN 1.0 ELSE 0.0 END) >= 0.5 AS widespread FROM c GROUP BY metric""",
    "dataset_traits": _BASE + "SELECT finding_key, count(DISTINCT episode_id) AS episodes FROM findings GROUP BY 1 HAVING count(DISTINCT episode_id) >= 4",
    "task_traits": _BASE
    + """, t AS (SELECT DISTINCT episode_id, 'task' || (substring(episode_id, 3)::INT % 4) AS task FROM findings), z AS (SELECT task, count(*) AS size FROM t GROUP BY 1),
e AS (SELECT finding_key, task, count(DISTINCT episode_id) AS n FROM findings JOIN t USING (episode_id) GROUP BY ALL), o AS (SELECT finding_key FROM e GROUP BY 1 HAVING count(*) = 1)
SELECT finding_key, task, n FROM e JOIN o USING (finding_key) JOIN z USING (task) WHERE n = size""",
    "worst_findings": _BASE
    + """SELECT episode_id, place, finding_key, round(points, 6) AS points FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY CASE WHEN severity = 'critical' THEN 0 ELSE 1 END, points, finding_key) AS place FROM findings) WHERE place <= 3""",
}
