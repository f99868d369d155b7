"""Queries of gates, names, eligibility and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as N
from ..operators import gates as G
from ..operators import integrity
from . import datasets as D
from . import eligibility as E
from . import scoring as S
from .queries_scoring import SQL as SCORE_SQL
from .queries_scoring import _resolved


def _events(spark, sf_dir):
    return D.table(spark, sf_dir, "events")


# -- gates

NEEDED = "metric string, level string, needs array<string>, least int, regular_only boolean"


def gated_results(spark, sf_dir):
    """Rates of missing values need clicks or views, flat stretches a regular stream, spikes 150 rows."""
    samples, streams = D.event_samples(spark, sf_dir), D.event_streams(spark, sf_dir)
    found = integrity.missing_pct(samples).unionByName(integrity.flatline_pct(samples)).unionByName(integrity.spike_pct(samples))
    needed = spark.createDataFrame([("missing_pct", "channel", ["proprio.view", "proprio.click"], 1, False), ("flatline_pct", "channel", [], 2, True), ("spike_pct", "channel", [], 150, False)], NEEDED)
    streams = streams.withColumn("taxonomy", F.when(F.col("stream") == "signup", "unmapped.signup").otherwise(F.col("taxonomy")))
    out = G.gated(found, needed, streams, G.stream_sizes(samples))
    return D.rounded(out.select("episode_id", "stream", "channel", "metric", "value", "availability", "reason"))


def episode_gate(spark, sf_dir):
    streams = D.event_streams(spark, sf_dir).where("NOT (episode_id = 'ep3' AND stream = 'click') AND episode_id <> 'ep5'")
    return G.episode_gate(D.event_streams(spark, sf_dir), streams, ["proprio.view", "proprio.click"])


def increasing_axis(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = e.select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("episode_id"), F.col("event_type").alias("stream"), F.col("event_id").alias("row_idx"), F.when(F.col("event_id") % 400 != 0, D.micros("ts")).alias("native"))
    sorted_ = D.event_samples(spark, sf_dir).select("episode_id", "stream", "row_idx", "native")
    return G.increasing_axis(s.unionByName(sorted_))


def unclaimed_paths(spark, sf_dir):
    e = _events(spark, sf_dir)
    path = F.concat_ws("/", F.lit("data"), "event_type", (F.col("user_id") % 8).cast("string"), (F.col("event_id") % 50).cast("string"))
    return G.unclaimed(e.select(path.alias("path")).distinct(), spark.createDataFrame([("data/click",), ("data/view/3/",), ("data/pur",)], "path string"))


def touched_windows(spark, sf_dir):
    s = D.event_samples(spark, sf_dir)
    w = s.groupBy("episode_id", "stream", F.floor(F.col("row_idx") / 25).alias("window")).agg(F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))
    bad = s.where("v > 260").select("episode_id", F.when(F.col("row_idx") % 2 == 0, F.col("stream")).alias("stream"), F.when(F.col("row_idx") % 7 > 0, F.col("row_idx")).alias("first"), F.when(F.col("row_idx") % 7 > 0, F.col("row_idx") + 3).alias("last"))
    return G.touched_windows(bad, w)


def selected_cameras(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "image").when(F.col("doc_id") % 3 == 1, "video").otherwise("series")
    depth = F.when(F.col("lang") == "de", F.lit("camera.depth")).when(F.col("lang") == "en", F.lit("camera.rgb"))
    return d.select("doc_id", kind.alias("kind"), depth.alias("taxonomy")).where(G.is_camera(F.col("kind"), F.col("taxonomy")))


# -- names

ENTRIES = (
    N.Entry("proprio.click", ("click", "clicked"), patterns=(N.Pattern(("robot", "robot.*"), ("*click*", "view_?"), ("*hand*",)),)),
    N.Entry("proprio.view", ("view",), ("arm",), (N.Pattern(("robot*",), ("view*",)),)),
    N.Entry("proprio.view_copy", ("view",)),
    N.Entry("proprio.hand", (), ("hand",)),
)


def _names(e):
    k, u = F.col("user_id") % 5, (F.col("user_id") % 3).cast("string")
    return (
        F.when(k == 0, F.concat(F.lit("robot."), "event_type", F.lit("_x")))
        .when(k == 1, F.concat(F.lit("arm."), F.upper("event_type"), F.lit("-pos_rad")))
        .when(k == 2, F.concat(F.lit("hand.left."), u))
        .when(k == 3, F.concat("event_type", F.lit(" mm")))
        .otherwise(F.concat(F.lit("hand_x.arm_mm.j"), u))
    )


def name_roles(spark, sf_dir):
    names = _events(spark, sf_dir).select(_names(None).alias("name"))
    out = N.roles(names, N.alias_table(spark, ENTRIES))
    return out.withColumn("candidates", F.array_join("candidates", ","))


def channel_types(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.when(F.col("user_id") % 4 == 0, "robot.left").when(F.col("user_id") % 4 == 1, "Robot").when(F.col("user_id") % 4 == 2, "other").alias("feature"), F.concat("event_type", F.when(F.col("event_id") % 3 == 0, F.lit("_1")).when(F.col("event_id") % 3 == 1, F.lit(".Hand")).otherwise(F.lit(""))).alias("name")).distinct()
    return e.withColumn("taxonomy", N.match_channel(F.col("feature"), F.col("name"), ENTRIES))


def preferred_types(spark, sf_dir):
    e = _events(spark, sf_dir)
    sources = F.array(*map(F.lit, ("inferred", "declared", "file", "rumour")))
    claims = e.select(F.concat(F.lit("f"), F.col("user_id") % 40).alias("feature"), F.element_at(sources, (F.col("event_id") % 4 + 1).cast("int")).alias("source"), F.when(F.col("value") > 200, F.lit(None)).when(F.col("user_id") % 2 == 0, "even").otherwise(F.col("event_type")).alias("taxonomy"))
    return N.preferred_type(claims)


def asserted_types(spark, sf_dir):
    e = _events(spark, sf_dir)
    channels = e.select(F.col("event_type").alias("feature"), (F.col("user_id") % 4).alias("index"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("source")).distinct()
    a = spark.createDataFrame([("click", 0, None, "a"), ("click", 1, "s1", "b"), ("view", 2, "s0", "c"), ("view", 2, "s2", "d")], "feature string, index long, source string, taxonomy string")
    return N.asserted(channels, a)


def stream_addresses(spark, sf_dir):
    """How cameras and episodes are named: by field, type and instance; by source and episode."""
    d = D.table(spark, sf_dir, "documents")
    field, instance = F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return d.select("doc_id", N.camera_key(field, F.lit("camera.rgb"), instance).alias("camera"), N.qualified_episode(F.col("source"), F.col("doc_id").cast("string"), F.col("doc_id") % 5 == 0).alias("episode"))


# -- eligibility and report tables


def _findings(spark, sf_dir):
    return S.findings(_resolved(spark, sf_dir))


def calibrated_findings(spark, sf_dir):
    rows = _findings(spark, sf_dir).withColumns({"taxonomy": F.concat(F.lit("proprio."), "stream"), "noise_above": F.col("stream") == "view"})
    manifests = spark.createDataFrame([("spike_pct", "proprio.click", True, "accepted"), ("spike_pct", "proprio.view", False, "other context")], "metric string, taxonomy string, accepted boolean, reason string")
    out = E.calibrated(rows, manifests, ("spike_pct", "flatline_pct"))
    return out.select("episode_id", "finding_key", "severity", "consequence", "evidence_strength", "calibration_reason", F.substring("id", 1, 12).alias("id"))


def _ledger(spark, sf_dir):
    capabilities = spark.createDataFrame([("numeric", "missing_pct"), ("numeric", "spike_pct"), ("timing", "drop_rate")], "capability string, metric string")
    state = F.when(F.col("status") != "not_applicable", "computed").when(F.col("reason") == "not regular", "not_applicable").otherwise("unavailable")
    return E.episode_ledger(_resolved(spark, sf_dir).withColumn("availability", state), capabilities)


def episode_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)


def dataset_ledger(spark, sf_dir):
    return E.dataset_ledger(_ledger(spark, sf_dir))


def requirement_reasons(spark, sf_dir):
    resolved = _resolved(spark, sf_dir)
    streams = D.event_streams(spark, sf_dir).select("episode_id", "stream", F.when(F.col("stream") == "signup", F.lit(None)).otherwise(F.col("taxonomy")).alias("taxonomy"), F.when((F.col("stream") == "error") & (F.col("episode_id") > "ep3"), "skipped").otherwise("computed").alias("payload"))
    needed = E.Requirements(families=("motion", "integrity"), capabilities=("timing", "video_quality"), metrics=("spike_pct", "recorded_hz"), payloads=True, bindings=True)
    return E.requirement_reasons(resolved, resolved, streams, _ledger(spark, sf_dir), needed)


def reason_codes(spark, sf_dir):
    return E.reason_codes(_resolved(spark, sf_dir).select("episode_id", "stream", "channel", "metric", "reason"))[0]


def reason_table(spark, sf_dir):
    return E.reason_codes(_resolved(spark, sf_dir).select("reason"))[1]


def shared_findings(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.concat(F.lit("ep"), F.col("user_id") % 8).alias("episode_id"), F.col("event_type").alias("stream"), F.lit("drop_rate").alias("metric"), F.floor(F.col("value") / 100).cast("double").alias("value"), F.lit("").alias("evidence"))
    clocks = D.event_streams(spark, sf_dir).where("stream <> 'error'").select("episode_id", "stream", F.when(F.col("stream").isin("click", "view"), "screen").otherwise("shop").alias("clock"))
    return E.shared_findings(e.distinct(), clocks)


def flagged_rows(spark, sf_dir):
    return D.rounded(E.flagged_rows(_resolved(spark, sf_dir)))


def finding_groups(spark, sf_dir):
    return E.finding_groups(_findings(spark, sf_dir))


def episode_extent(spark, sf_dir):
    return D.rounded(E.episode_extent(D.event_samples(spark, sf_dir)), 3)


def critical_keys(spark, sf_dir):
    """Findings under 60 points block here."""
    return E.critical_keys(_findings(spark, sf_dir).withColumn("consequence", F.when(F.col("points") < 60, "block").otherwise("review")))


def strided_episodes(spark, sf_dir):
    return E.strided(D.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 30)


def session_overlap(spark, sf_dir):
    e = _events(spark, sf_dir)
    return E.overlap(e.where("event_type = 'click' AND value > 150"), e.where("event_type = 'purchase' AND value > 150"), "user_id")


def first_seen(spark, sf_dir):
    return E.first_seen(D.table(spark, sf_dir, "conversations").withColumn("place", F.col("conv_id").cast("string")), "text", "place")


def graded_match(spark, sf_dir):
    e = _events(spark, sf_dir)
    key = {"field": F.col("event_type"), "instance": F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 3), "path": F.when(F.col("user_id") % 2 > 0, "p")}
    d = e.select(*[c.alias(n) for n, c in key.items()]).distinct()
    graded = e.where("event_type <> 'error'").select(*[c.alias(n) for n, c in key.items()], "value").groupBy(*key).agg(F.when(F.max("value") > 300, "critical").otherwise("good").alias("status"))
    return E.graded_match(d, graded)


def review_findings(spark, sf_dir):
    d = _events(spark, sf_dir).groupBy(F.concat(F.lit("ep"), F.col("user_id") % 8).alias("episode_id"), F.col("event_type").alias("name")).agg(F.max("value").alias("value"))
    return E.review_findings(d, {"click": 200.0, "view": 250.0})


def _decided(spark, sf_dir):
    return S.decisions(D.event_samples(spark, sf_dir).select("episode_id").distinct(), _findings(spark, sf_dir))


def _windows(spark, sf_dir):
    s = D.event_samples(spark, sf_dir)
    return s.groupBy("episode_id", "stream", F.floor(F.col("row_idx") / 25).alias("window")).agg(F.when(F.max("v") > 300, "failed").when(F.max("v") > 200, "pending").otherwise("pass").alias("state"))


def resolved_windows(spark, sf_dir):
    return E.resolved_windows(_windows(spark, sf_dir), _decided(spark, sf_dir))


def window_sufficiency(spark, sf_dir):
    passing = _windows(spark, sf_dir).groupBy("episode_id").agg(F.sum((F.col("state") == "pass").cast("int")).alias("passing"))
    decided = _decided(spark, sf_dir).withColumn("decision", F.when(F.col("decision") == "review", "pass").otherwise(F.col("decision")))
    return E.window_sufficiency(decided, passing, 10)


def report_warnings(spark, sf_dir):
    e = _events(spark, sf_dir)
    kinds = F.array(*map(F.lit, ("instruction", "corrupt", "swap", "viewpoint", "other")))
    return E.report_warnings(e.where("value > 150").select(F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("kind"), F.col("user_id").alias("episode_id")))


QUERIES = {
    f.__name__: f
    for f in (gated_results, episode_gate, increasing_axis, unclaimed_paths, touched_windows, selected_cameras, name_roles, channel_types, preferred_types, asserted_types, stream_addresses, calibrated_findings)
    + (episode_ledger, dataset_ledger, requirement_reasons, reason_codes, reason_table, shared_findings, flagged_rows, finding_groups, episode_extent, critical_keys, strided_episodes, session_overlap, first_seen)
    + (graded_match, review_findings, resolved_windows, window_sufficiency, report_warnings)
}

_RES = f"res AS ({SCORE_SQL['quality_results']})"
_FIND = f"found AS ({SCORE_SQL['quality_findings']})"
_WIN = "win AS (SELECT episode_id, stream, row_idx // 25 AS win, CASE WHEN max(v) > 300 THEN 'failed' WHEN max(v) > 200 THEN 'pending' ELSE 'pass' END AS state FROM samples GROUP BY ALL)"
_DEC = f"dec AS ({SCORE_SQL['quality_decisions']})"
_LEDGER = """st AS (SELECT *, CASE WHEN status <> 'not_applicable' THEN 'computed' WHEN reason = 'not regular' THEN 'not_applicable' ELSE 'unavailable' END AS a FROM res),
per AS (SELECT episode_id, metric, count(*) FILTER (a <> 'not_applicable') AS eligible, count(*) FILTER (a = 'computed') AS computed, count(*) FILTER (a = 'error') AS error FROM st GROUP BY ALL),
ledger AS (SELECT episode_id, 'metric' AS kind, metric AS name, eligible, computed, error FROM per
  UNION ALL SELECT episode_id, 'capability', c.capability, sum(eligible)::BIGINT, sum(computed)::BIGINT, sum(error)::BIGINT FROM per JOIN (VALUES ('numeric', 'missing_pct'), ('numeric', 'spike_pct'), ('timing', 'drop_rate')) c(capability, metric) USING (metric) GROUP BY ALL)"""
_NAME = """CASE user_id % 5 WHEN 0 THEN 'robot.' || event_type || '_x' WHEN 1 THEN 'arm.' || upper(event_type) || '-pos_rad' WHEN 2 THEN 'hand.left.' || (user_id % 3) WHEN 3 THEN event_type || ' mm' ELSE 'hand_x.arm_mm.j' || (user_id % 3) END"""

SQL = {
    "gated_results": f"""WITH {D.EVENTS}, every AS (SELECT episode_id, stream, channel, metric, value, CASE WHEN reason IS NULL THEN 'computed' ELSE 'not_applicable' END AS availability, reason FROM ({SCORE_SQL["quality_results"]}) WHERE metric IN ('missing_pct', 'flatline_pct', 'spike_pct')),
n AS (SELECT episode_id, stream, count(DISTINCT row_idx) AS n FROM samples GROUP BY ALL),
w AS (SELECT e.*, CASE WHEN metric = 'missing_pct' AND stream NOT IN ('click', 'view') THEN 'needs one of proprio.click, proprio.view, got ' || CASE WHEN stream = 'signup' THEN 'unmapped.' ELSE 'proprio.' END || stream
  WHEN metric = 'flatline_pct' AND NOT regular THEN 'sampling is not regular' WHEN metric = 'spike_pct' AND n < 150 THEN 'fewer than 150 samples' END AS why FROM every e JOIN streams USING (episode_id, stream) JOIN n USING (episode_id, stream))
SELECT episode_id, stream, channel, metric, CASE WHEN why IS NULL THEN value END AS value, CASE WHEN metric = 'missing_pct' AND why IS NOT NULL AND stream <> 'signup' THEN 'not_applicable' WHEN why IS NOT NULL OR availability <> 'computed' THEN 'unavailable' ELSE 'computed' END AS availability, coalesce(why, reason) AS reason FROM w""",
    "episode_gate": f"WITH {D.EVENTS} SELECT episode_id, CASE WHEN episode_id = 'ep5' THEN 'episode carries no proprio.click, proprio.view stream' WHEN episode_id = 'ep3' OR count(*) FILTER (stream = 'click') = 0 THEN CASE WHEN count(*) FILTER (stream = 'view') = 0 THEN 'episode carries no proprio.click, proprio.view stream' ELSE 'episode carries no proprio.click stream' END WHEN count(*) FILTER (stream = 'view') = 0 THEN 'episode carries no proprio.view stream' END AS reason FROM streams GROUP BY 1",
    "increasing_axis": f"""WITH {D.EVENTS}, s AS (SELECT 'u' || (user_id % 20) AS episode_id, event_type AS stream, event_id AS row_idx, CASE WHEN event_id % 400 <> 0 THEN epoch_us(ts) END AS native FROM events UNION ALL SELECT episode_id, stream, row_idx, native FROM samples),
g AS (SELECT *, native - lag(native) OVER (PARTITION BY episode_id, stream ORDER BY row_idx) AS step FROM s)
SELECT episode_id, stream, count(*) AS rows, count(native) AS ticks, CASE WHEN count(native) < count(*) THEN 'ticks are not finite' WHEN count(native) < 2 THEN 'fewer than two ticks' WHEN min(step) <= 0 THEN 'ticks do not increase' END AS reason FROM g GROUP BY ALL""",
    "unclaimed_paths": "SELECT DISTINCT 'data/' || event_type || '/' || (user_id % 8) || '/' || (event_id % 50) AS path FROM events WHERE event_type <> 'click' AND NOT (event_type = 'view' AND user_id % 8 = 3)",
    "touched_windows": f"""WITH {D.EVENTS}, w AS (SELECT episode_id, stream, row_idx // 25 AS win, min(row_idx) AS a, max(row_idx) AS b FROM samples GROUP BY ALL),
f AS (SELECT episode_id, CASE WHEN row_idx % 2 = 0 THEN stream END AS fs, CASE WHEN row_idx % 7 > 0 THEN row_idx END AS fa FROM samples WHERE v > 260)
SELECT w.episode_id, w.stream, win AS "window", count(f.episode_id) AS findings FROM w LEFT JOIN f ON w.episode_id = f.episode_id AND (fs IS NULL OR fs = w.stream) AND (fa IS NULL OR (fa <= b AND fa + 3 >= a)) GROUP BY ALL""",
    "selected_cameras": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'image' ELSE 'video' END AS kind, CASE lang WHEN 'en' THEN 'camera.rgb' END AS taxonomy FROM documents WHERE doc_id % 3 < 2 AND (lang IS NULL OR lang <> 'de')",
    "name_roles": f"""WITH n AS (SELECT DISTINCT user_id % 5 AS k, user_id % 3 AS j, event_type AS e, {_NAME} AS name FROM events),
d AS (SELECT DISTINCT name, CASE k WHEN 0 THEN e WHEN 1 THEN 'arm' WHEN 2 THEN 'hand' WHEN 3 THEN e ELSE 'arm' END AS stem, k FROM n)
SELECT DISTINCT name, CASE WHEN k = 1 AND stem = 'arm' THEN 'arm' ELSE stem END AS stem,
  CASE WHEN k IN (0, 3) THEN CASE WHEN stem = 'click' THEN 'proprio.click' END WHEN k IN (1, 4) THEN 'proprio.view' ELSE 'proprio.hand' END AS taxonomy,
  CASE WHEN k IN (0, 3) AND stem = 'view' THEN 'proprio.view,proprio.view_copy' ELSE '' END AS candidates,
  CASE WHEN k = 0 THEN 'x' END AS axis, CASE k WHEN 1 THEN 'rad' WHEN 3 THEN 'mm' END AS unit,
  CASE WHEN k IN (0, 3) AND stem <> 'click' THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM d""",
    "channel_types": """WITH e AS (SELECT DISTINCT CASE user_id % 4 WHEN 0 THEN 'robot.left' WHEN 1 THEN 'Robot' WHEN 2 THEN 'other' END AS feature, event_type || CASE event_id % 3 WHEN 0 THEN '_1' WHEN 1 THEN '.Hand' ELSE '' END AS name FROM events),
m AS (SELECT *, lower(feature) LIKE 'robot%' AND (lower(name) GLOB '*click*' OR lower(name) GLOB 'view_?') AND NOT lower(name) GLOB '*hand*' AS c, lower(feature) LIKE 'robot%' AND lower(name) GLOB 'view*' AS v FROM e)
SELECT feature, name, CASE WHEN c AND NOT v THEN 'proprio.click' WHEN v AND NOT c THEN 'proprio.view' END AS taxonomy FROM m""",
    "preferred_types": """WITH c AS (SELECT 'f' || (user_id % 40) AS feature, event_id % 4 AS r, CASE WHEN value > 200 THEN NULL WHEN user_id % 2 = 0 THEN 'even' ELSE event_type END AS t FROM events),
b AS (SELECT *, max(r) OVER (PARTITION BY feature) AS best FROM c WHERE t IS NOT NULL AND r < 3)
SELECT feature, CASE best WHEN 2 THEN 'file' WHEN 1 THEN 'declared' ELSE 'inferred' END AS source, CASE WHEN count(DISTINCT t) = 1 THEN min(t) END AS taxonomy, count(DISTINCT t) > 1 AS conflict FROM b WHERE r = best GROUP BY feature, best""",
    "asserted_types": "SELECT DISTINCT event_type AS feature, user_id % 4 AS \"index\", 's' || (user_id % 3) AS source, CASE WHEN event_type = 'click' AND user_id % 4 = 0 THEN 'a' WHEN event_type = 'click' AND user_id % 4 = 1 AND user_id % 3 = 1 THEN 'b' WHEN event_type = 'view' AND user_id % 4 = 2 AND user_id % 3 = 0 THEN 'c' WHEN event_type = 'view' AND user_id % 4 = 2 AND user_id % 3 = 2 THEN 'd' END AS asserted FROM events",
    "stream_addresses": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND source IS NOT NULL THEN source WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN 'camera.rgb[' || lang || ']' ELSE 'camera.rgb' END AS camera, CASE WHEN doc_id % 5 = 0 THEN source ELSE source || '::' || doc_id END AS episode FROM documents",
    "calibrated_findings": f"""WITH {_FIND}, x AS (SELECT *, metric IN ('spike_pct', 'flatline_pct') AND severity = 'critical' AS mine, metric = 'spike_pct' AND stream = 'click' AS ok FROM found)
SELECT episode_id, finding_key, severity, CASE WHEN mine THEN CASE WHEN ok THEN 'block' ELSE 'review' END ELSE consequence END AS consequence, CASE WHEN mine THEN CASE WHEN ok THEN 'statistical' ELSE 'heuristic' END END AS evidence_strength,
  CASE WHEN mine AND NOT ok THEN CASE WHEN metric = 'spike_pct' AND stream = 'view' THEN 'other context' ELSE 'no manifest' END END AS calibration_reason, sha256(episode_id || chr(31) || stream || chr(31) || channel || chr(31) || metric)[1:12] AS id FROM x""",
    "episode_ledger": f"WITH {_RES}, {_LEDGER} SELECT * FROM ledger",
    "dataset_ledger": f"WITH {_RES}, {_LEDGER} SELECT kind, name, sum(eligible)::BIGINT AS eligible, sum(computed)::BIGINT AS computed, sum(error)::BIGINT AS error, count(*) FILTER (eligible > 0 AND computed = eligible) AS whole, count(*) AS episodes FROM ledger GROUP BY ALL",
    "requirement_reasons": f"""WITH {_RES}, {_LEDGER}, ep AS (SELECT DISTINCT episode_id FROM res), whole AS (SELECT * FROM ledger WHERE eligible > 0 AND computed = eligible), graded AS (SELECT * FROM res WHERE points IS NOT NULL),
ev AS (SELECT DISTINCT 'ep' || (user_id % 8) AS episode_id, event_type AS stream FROM events)
SELECT episode_id, 'graded_result' AS id, 'requirement' AS kind, 'no metric produced a graded result' AS detail FROM ep WHERE episode_id NOT IN (SELECT episode_id FROM graded)
UNION SELECT episode_id, 'family:motion', 'requirement', 'required family motion graded no result' FROM ep
UNION SELECT episode_id, 'family:integrity', 'requirement', 'required family integrity graded no result' FROM ep WHERE episode_id NOT IN (SELECT episode_id FROM graded WHERE metric IN ('flatline_pct', 'missing_pct', 'spike_pct'))
UNION SELECT episode_id, 'payload:proprio.error', 'requirement', 'stream proprio.error payload skipped' FROM ev WHERE stream = 'error' AND episode_id > 'ep3'
UNION SELECT episode_id, 'binding:signup', 'binding', 'stream signup is not bound' FROM ev WHERE stream = 'signup'
UNION SELECT episode_id, 'capability:' || c, 'requirement', 'required capability ' || c || ' was not fully evaluated' FROM ep, (VALUES ('numeric'), ('timing'), ('video_quality')) t(c) WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.episode_id = ep.episode_id AND w.kind = 'capability' AND w.name = c)
UNION SELECT episode_id, 'metric:' || m, 'requirement', 'required metric ' || m || ' was not fully evaluated' FROM ep, (VALUES ('spike_pct'), ('recorded_hz')) t(m) WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.episode_id = ep.episode_id AND w.kind = 'metric' AND w.name = m)""",
    "reason_codes": f"WITH {_RES}, t AS (SELECT reason, row_number() OVER (ORDER BY reason)::INT AS code FROM (SELECT DISTINCT reason FROM res WHERE reason IS NOT NULL)) SELECT episode_id, stream, channel, metric, code FROM res LEFT JOIN t USING (reason)",
    "reason_table": f"WITH {_RES} SELECT row_number() OVER (ORDER BY reason)::INT AS code, reason FROM (SELECT DISTINCT reason FROM res WHERE reason IS NOT NULL)",
    "shared_findings": """WITH e AS (SELECT DISTINCT 'ep' || (user_id % 8) AS episode_id, event_type AS stream, floor(value / 100) AS value, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('click', 'view') THEN 'screen' ELSE 'shop' END AS clock FROM events),
g AS (SELECT episode_id, clock, value, list(stream ORDER BY stream) AS s FROM e GROUP BY ALL) SELECT episode_id, 'drop_rate' AS metric, value, '' AS evidence, s[1] AS stream, array_to_string(s[2:], ',') AS shared_by FROM g""",
    "flagged_rows": f"WITH {_RES}, g AS (SELECT metric, count(*) FILTER (status = 'critical') AS criticals, count(*) FILTER (status = 'warning') AS warnings, min(points) AS worst FROM res WHERE status IN ('warning', 'critical') GROUP BY 1) SELECT *, row_number() OVER (ORDER BY criticals DESC, warnings DESC, metric)::INT AS place FROM g",
    "finding_groups": f"WITH {_FIND} SELECT metric, severity, count(*) AS findings, count(DISTINCT episode_id) AS episodes FROM found GROUP BY ALL",
    "episode_extent": f"WITH {D.EVENTS}, n AS (SELECT episode_id, stream, count(*) AS n, min(t) AS a, max(t) AS b FROM samples GROUP BY ALL) SELECT episode_id, round(max(b) - min(a), 3) AS seconds, max(n) AS rows FROM n GROUP BY 1",
    "critical_keys": f"WITH {_FIND} SELECT episode_id, string_agg(DISTINCT finding_key, ',' ORDER BY finding_key) AS finding_keys FROM found WHERE points < 60 GROUP BY 1",
    "strided_episodes": "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, greatest(1, count(*) OVER () // 30) AS step FROM orders) SELECT o_orderkey FROM o WHERE k % step = 0 AND k < step * 30",
    "session_overlap": "SELECT user_id FROM events WHERE event_type = 'click' AND value > 150 INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150",
    "first_seen": "SELECT text, min(conv_id::VARCHAR) AS first FROM conversations WHERE text IS NOT NULL GROUP BY 1",
    "graded_match": """WITH d AS (SELECT event_type AS field, CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS instance, CASE WHEN user_id % 2 > 0 THEN 'p' END AS path, max(value) AS top FROM events GROUP BY ALL)
SELECT field, instance, path, CASE WHEN field = 'error' THEN NULL WHEN top > 300 THEN 'critical' ELSE 'good' END AS status FROM d""",
    "review_findings": "WITH d AS (SELECT 'ep' || (user_id % 8) AS episode_id, event_type AS name, max(value) AS value FROM events GROUP BY ALL) SELECT episode_id, 'diagnostic.' || name AS metric, value, CASE name WHEN 'click' THEN 200.0::DOUBLE WHEN 'view' THEN 250.0::DOUBLE END AS threshold, 'review' AS consequence FROM d WHERE value > CASE name WHEN 'click' THEN 200 WHEN 'view' THEN 250 END",
    "resolved_windows": f"WITH {D.EVENTS}, {_WIN}, {_DEC} SELECT episode_id, stream, win AS \"window\", CASE WHEN decision = 'blocked' THEN 'blocked' WHEN state = 'pending' THEN decision ELSE state END AS state FROM win JOIN dec USING (episode_id)",
    "window_sufficiency": f"WITH {D.EVENTS}, {_WIN}, {_DEC} SELECT count(*) FILTER (state = 'pass') AS windows, 10 AS required, count(*) FILTER (state = 'pass') >= 10 AS sufficient FROM win JOIN dec USING (episode_id) WHERE decision IN ('pass', 'review')",
    "report_warnings": """WITH g AS (SELECT ['instruction', 'corrupt', 'swap', 'viewpoint', 'other'][event_id % 5 + 1] AS kind, count(DISTINCT user_id) AS episodes FROM events WHERE value > 150 GROUP BY 1)
SELECT kind, episodes, episodes || CASE WHEN episodes = 1 THEN ' episode ' ELSE ' episodes ' END || CASE kind WHEN 'instruction' THEN 'have no task instruction' WHEN 'corrupt' THEN 'hold corrupt footage' WHEN 'swap' THEN 'hold another camera''s footage' WHEN 'viewpoint' THEN 'come after a change of view' ELSE 'need a look' END AS text FROM g""",
}
