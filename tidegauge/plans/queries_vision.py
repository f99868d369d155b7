"""Queries of camera metrics, defects and contracts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import contracts as K
from ..operators import vision as V
from . import datasets as D
from . import defects as X


def frame_table(spark, sf_dir):
    """Vectors as pictures of 8 by 8 pixels; a camera for each label."""
    e = D.table(spark, sf_dir, "embeddings")
    pixel = F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), (128 + 400 * x).cast("int"))).cast("bigint")), 2, "0"))
    gray = F.unhex(F.array_join(pixel, ""))
    return e.select(F.concat(F.lit("ep"), F.col("vec_id") % 5).alias("episode_id"), F.concat(F.lit("cam"), "label").alias("camera"), F.col("vec_id").cast("bigint").alias("frame_idx"), (F.col("vec_id") / 10).alias("pts"), F.lit(8).alias("width"), F.lit(8).alias("height"), gray.alias("gray"))


def frame_stats(spark, sf_dir):
    return D.rounded(V.frame_stats(frame_table(spark, sf_dir)).drop("thumb"))


def event_stats(spark, sf_dir):
    """Events as frames whose statistics follow from their values."""
    s = D.event_samples(spark, sf_dir)
    v = F.least("v", F.lit(255.0))
    return s.select("episode_id", F.col("stream").alias("camera"), F.col("row_idx").alias("frame_idx"), (F.col("native") / 1e9).alias("pts"), F.lit(64).alias("width"), F.lit(48).alias("height"), v.alias("mean"), (v * 0.8).alias("p5"), (v * 1.2).alias("p95"), (1 - v / 255).alias("dark"), (v / 255).alias("white"), (v / 20).alias("noise"), (v / 2).alias("native_spread"), v.alias("loss"), F.array((v / 255).cast("float")).alias("thumb"))


_FROM_STATS = ("sharpness_score", "exposure_level", "contrast_score", "exposure_shift_pct", "blank_frame_pct", "corrupt_frame_pct", "dark_frame_pct", "bright_frame_pct", "pts_defect_pct", "max_gap_s")


def _stat_metric(spark, sf_dir, name):
    return D.rounded(getattr(V, name)(event_stats(spark, sf_dir)).select("episode_id", "camera", "value", "availability", "reason"))


def frozen_frame_pct(spark, sf_dir):
    stats = event_stats(spark, sf_dir)
    changes = V.frame_changes(stats)
    controls = stats.groupBy("episode_id", "frame_idx").agg(F.avg("mean").alias("step"))
    return D.rounded(V.frozen_frame_pct(changes, V.moving_frames(controls)).select("episode_id", "camera", "value", "reason"))


def still_scene_pct(spark, sf_dir):
    return D.rounded(V.still_scene_pct(V.frame_changes(event_stats(spark, sf_dir))).select("episode_id", "camera", "value", "reason"))


def cut_count(spark, sf_dir):
    stats = event_stats(spark, sf_dir)
    jumps = stats.select("episode_id", "frame_idx", F.col("mean").alias("z"))
    return V.cut_count(V.frame_changes(stats), jumps).select("episode_id", "camera", "value", "reason")


def camera_sync_skew(spark, sf_dir):
    stats = event_stats(spark, sf_dir).withColumn("recorded", F.col("pts") - F.col("mean") / 1000)
    return D.rounded(V.camera_sync_skew_ms(stats).select("episode_id", "value", "reason"))


def frame_count_vs_timebase(spark, sf_dir):
    stats = event_stats(spark, sf_dir)
    stamps = stats.groupBy("episode_id", "camera").agg(F.count_if(F.col("mean") > 20).alias("n"))
    return D.rounded(V.frame_count_vs_timebase(stats, stamps).select("episode_id", "camera", "value", "reason"))


def regrade_corrupt(spark, sf_dir):
    return V.regrade_corrupt(event_stats(spark, sf_dir), times=3.0)


def index_ranges(spark, sf_dir):
    """Orders as an index that expects lines 1 to 4."""
    index = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("episode_id"), F.lit(1).alias("from_index"), F.lit(5).alias("to_index"), F.lit(4).alias("length"))
    rows = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("episode_id"), F.col("l_linenumber").alias("index"))
    return K.index_range_mismatch_count(index, rows).select("episode_id", "value", "reason")


def task_instruction_missing(spark, sf_dir):
    c = D.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("episode_id")).agg(F.collect_list(F.when(F.col("role") == "system", F.col("text"))).alias("tasks"))
    return K.task_instruction_missing(c).select("episode_id", "value", "reason")


def episode_not_in_metadata(spark, sf_dir):
    index = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("episode_id"))
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("episode_id"))
    return K.episode_not_in_metadata(index, rows).select("episode_id", "value")


def defect_detection(spark, sf_dir):
    """What each metric makes of each defect put into clean recordings."""
    return D.rounded(X.detection(X.clean_recording(spark, rows=200), ("missing_pct", "flatline_pct", "spike_pct", "monotonic_violations", "limit_proximity_pct")), 4)


_EV = f"""{D.EVENTS},
f AS (SELECT episode_id, stream AS camera, row_idx AS frame_idx, native / 1e9 AS pts, least(v, 255.0) AS mean FROM samples)"""
_MED = "SELECT episode_id, camera, round(median({0}), 6) AS value, 'computed' AS availability, NULL AS reason FROM f GROUP BY ALL"
_PCT = "SELECT episode_id, camera, round(100 * avg(CASE WHEN {0} THEN 1.0 ELSE 0.0 END), 6) AS value, 'computed' AS availability, NULL AS reason FROM f GROUP BY ALL"
_BLANK = "mean * 1.2 - mean * 0.8 < 5"
_STEP = "s AS (SELECT *, pts - lag(pts) OVER (PARTITION BY episode_id, camera ORDER BY pts, frame_idx) AS step FROM f)"

QUERIES = {f"vision_{n}": partial(_stat_metric, name=n) for n in _FROM_STATS} | {
    f"vision_{f.__name__}": f for f in (frame_stats, frozen_frame_pct, still_scene_pct, cut_count, camera_sync_skew, frame_count_vs_timebase, regrade_corrupt)
} | {f.__name__: f for f in (index_ranges, task_instruction_missing, episode_not_in_metadata, defect_detection)}

SQL = {
    "vision_sharpness_score": f"WITH {_EV} " + _MED.format("mean"),
    "vision_exposure_level": f"WITH {_EV} " + _MED.format("mean"),
    "vision_contrast_score": f"WITH {_EV} " + _MED.format("mean * 1.2 - mean * 0.8"),
    "vision_blank_frame_pct": f"WITH {_EV} " + _PCT.format(_BLANK),
    "vision_corrupt_frame_pct": f"WITH {_EV} " + _PCT.format(f"{_BLANK} OR (mean / 20 >= 5 AND mean / 2 >= 32)"),
    "vision_dark_frame_pct": f"WITH {_EV} " + _PCT.format("1 - mean / 255 >= 0.5 OR mean * 1.2 <= 40"),
    "vision_bright_frame_pct": f"WITH {_EV} " + _PCT.format("mean / 255 >= 0.5"),
    "vision_exposure_shift_pct": f"""WITH {_EV}, u AS (SELECT episode_id, camera, median(mean) AS m, median(1 - mean / 255) AS d, median(mean / 255) AS w FROM f GROUP BY ALL)
SELECT episode_id, camera, round(100 * avg(CASE WHEN abs(mean - m) > greatest(0.35 * m, 20) OR 1 - mean / 255 - d > 0.2 OR mean / 255 - w > 0.2 OR {_BLANK} THEN 1.0 ELSE 0.0 END), 6) AS value, 'computed' AS availability, NULL AS reason FROM f JOIN u USING (episode_id, camera) GROUP BY ALL""",
    "vision_max_gap_s": f"WITH {_EV}, {_STEP} SELECT episode_id, camera, round(max(step), 6) AS value, 'computed' AS availability, NULL AS reason FROM s GROUP BY ALL",
    "vision_pts_defect_pct": f"""WITH {_EV}, {_STEP}, p AS (SELECT episode_id, camera, median(step) AS period FROM s WHERE step > 0 GROUP BY ALL)
SELECT episode_id, camera, round(100.0 * count(*) FILTER (step <= 0 OR step > 1.5 * period) / count(step), 6) AS value, 'computed' AS availability, NULL AS reason FROM s JOIN p USING (episode_id, camera) GROUP BY ALL""",
    "vision_camera_sync_skew": f"""WITH {_EV}, d AS (SELECT episode_id, camera, median(pts - (pts - mean / 1000)) AS d FROM f GROUP BY ALL) SELECT episode_id, round(1000 * (max(d) - min(d)), 6) AS value, NULL AS reason FROM d GROUP BY ALL""",
    "vision_frame_count_vs_timebase": f"WITH {_EV} SELECT episode_id, camera, round(abs(count(*) - count(*) FILTER (mean > 20)) / count(*) FILTER (mean > 20), 6) AS value, NULL AS reason FROM f GROUP BY ALL",
    "vision_regrade_corrupt": f"""WITH {_EV}, u AS (SELECT camera, median(mean / 20) AS m FROM f GROUP BY 1) SELECT episode_id, camera, count(*) AS candidates FROM f JOIN u USING (camera) WHERE mean / 20 >= 5 AND mean / 20 >= 3 * m GROUP BY ALL HAVING count(*) >= 2""",
    "index_ranges": """WITH d AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) + 1 AS hi, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey::VARCHAR AS episode_id, CASE WHEN n IS NOT NULL THEN ((lo <> 1)::INT + (hi <> 5)::INT + (n <> 4)::INT)::DOUBLE END AS value, CASE WHEN n IS NULL THEN 'no rows' END AS reason FROM orders LEFT JOIN d ON o_orderkey = l_orderkey""",
    "task_instruction_missing": "SELECT conv_id::VARCHAR AS episode_id, CASE WHEN count(*) FILTER (role = 'system' AND trim(text) <> '') = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, NULL AS reason FROM conversations GROUP BY 1",
    "episode_not_in_metadata": "SELECT o_orderkey::VARCHAR AS episode_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM orders",
}
