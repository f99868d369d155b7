"""The grading policy: weights, bands and limits as small tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import yaml
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Grade:
    """How one metric is graded.  A band without good and bad, given explicitly, means "don't grade"."""

    metric: str
    family: str
    weight: float | None
    good: float | None = None
    bad: float | None = None
    core: bool = False
    report_only: bool = False
    contract: bool = False
    reduction: str = "value"  # or abs_dev, the relative deviation from a target
    taxonomies: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)


# Weights, bands (good, bad) and marks of the default policy.
DEFAULT = (
    Grade("effective_hz", "timing", 5, 0.10, 0.25, core=True, reduction="abs_dev"),
    Grade("dt_jitter_ms", "timing", 3, 5, None),
    Grade("drop_rate", "timing", 4, 0.01, 0.05, core=True),
    Grade("recorded_hz", "timing", 1),
    Grade("recorded_dt_spread_ms", "timing", 1),
    Grade("recorded_drop_estimate", "timing", 2),
    Grade("monotonic_violations", "timing", 4, 0.5, 1),
    Grade("missing_pct", "integrity", 4, 0.5, 5, core=True),
    Grade("flatline_pct", "integrity", 4, 50, 90, core=True),
    Grade("spike_pct", "integrity", 4, 0.1, 2),
    Grade("drift", "integrity", 1, report_only=True),
    Grade("snr_db", "integrity", 2, 30, 15),
    Grade("rotation_snr_db", "integrity", 2, 30, 15),
    Grade("dead_taxel_pct", "integrity", 3, 2, 10, core=True),
    Grade("hysteresis", "integrity", 2, 0.05, 0.20, core=True),
    Grade("mean_jerk_norm", "motion", 1, report_only=True),
    Grade("max_abs_jerk", "motion", 1, report_only=True),
    Grade("velocity_spike_pct", "motion", 4, report_only=True),
    Grade("log_dimensionless_jerk", "motion", 5, report_only=True),
    Grade("action_chatter", "motion", 2),
    Grade("still_drift", "motion", 1),
    Grade("vel_saturation_pct", "motion", 2, report_only=True),
    Grade("limit_proximity_pct", "motion", 1, report_only=True),
    Grade("hf_vibration_ratio", "motion", 2, 0.1, 0.3, core=True),
    Grade("p99_torque", "motion", 1, report_only=True),
    Grade("max_torque", "motion", None, report_only=True),
    Grade("mean_torque", "motion", None, report_only=True),
    Grade("energy_proxy", "motion", None, report_only=True),
    Grade("feature_mismatch_count", "schema", 0, 0.5, 1, contract=True),
    Grade("episode_file_mismatch", "schema", 0, 0.5, 1, contract=True),
    Grade("episode_not_in_metadata", "schema", 0, 0.5, 1, contract=True),
    Grade("index_range_mismatch_count", "schema", 0, 0.5, 1, contract=True),
    Grade("task_instruction_missing", "annotation", 5, core=True, report_only=True),
    Grade("sharpness_score", "vision", 5, 0.74, 0.55, core=True),
    Grade("exposure_shift_pct", "vision", 3, 10, 40, core=True),
    Grade("exposure_level", "vision", None, report_only=True),
    Grade("blank_frame_pct", "vision", 5, report_only=True),
    Grade("corrupt_frame_pct", "vision", 0, 1, 10, contract=True),
    Grade("contrast_score", "vision", 2, report_only=True),
    Grade("dark_frame_pct", "vision", 3, report_only=True),
    Grade("bright_frame_pct", "vision", 3, report_only=True),
    Grade("frame_count_vs_timebase", "vision", 4, 0.01, 0.05, core=True, contract=True),
    Grade("pts_defect_pct", "vision", 2, report_only=True),
    Grade("max_gap_s", "vision", 3, report_only=True),
    Grade("camera_sync_skew_ms", "vision", 2, report_only=True),
    Grade("camera_stream_present", "vision", 0, 1, 0.5, contract=True),
    Grade("frames_readable", "vision", 0, 1, 0.5, contract=True),
    Grade("video_format_consistency", "vision", 1, report_only=True),
    Grade("delivery_spec_met", "vision", 0, 1, 0.5, contract=True),
    Grade("frozen_frame_pct", "vision", 6, 0.01, 10, core=True),
    Grade("still_scene_pct", "vision", None, report_only=True),
    Grade("cut_count", "vision", 4, report_only=True),
    Grade("dropped_chunk_count", "vision", 4, report_only=True),
    Grade("video_control_lag_ms", "vision", None, report_only=True),
)
FAMILY_WEIGHTS = {"integrity": 3.0, "timing": 2.0, "motion": 2.0, "vision": 2.0, "annotation": 1.0}
LETTERS = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
#: (share of failing episodes up to, best letter; none: no cap)
CAPS = ((0.05, None), (0.15, "B"), (0.30, "C"), (1.0, "D"))
TRAIT_EPISODES = 20
LOW_SCORE = 70.0


def _float(x: float | None) -> float | None:
    return None if x is None else float(x)


def grades_table(spark: SparkSession, policy: tuple[Grade, ...] = DEFAULT) -> DataFrame:
    rows = [(g.metric, g.family, _float(g.weight), g.core, g.report_only, g.contract, g.reduction) for g in policy]
    return spark.createDataFrame(rows, "metric string, family string, weight double, core boolean, policy_report_only boolean, contract boolean, reduction string")


def bands_table(spark: SparkSession, policy: tuple[Grade, ...] = DEFAULT) -> DataFrame:
    """(metric, taxonomy, good, bad): a row that is there counts, whatever it holds."""
    rows = [(g.metric, "default", _float(g.good), _float(g.bad)) for g in policy if (g.good, g.bad) != (None, None)]
    rows += [(g.metric, t, _float(a), _float(b)) for g in policy for t, (a, b) in g.taxonomies.items()]
    return spark.createDataFrame(rows, "metric string, taxonomy string, good double, bad double")


def extended(base: tuple[Grade, ...], changes: dict[str, dict]) -> tuple[Grade, ...]:
    """A policy that replaces bands by metric and inherits weight, core and route where they aren't given."""
    known = {g.metric: g for g in base}
    for name, change in changes.items():
        if name not in known:
            raise ValueError(f"unknown metric {name!r}")
        known[name] = replace(known[name], **change)
    return tuple(known.values())


class _Strict(yaml.SafeLoader):
    """Refuses a key given twice."""

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=deep) for k, _ in node.value]
        if len(keys) != len(set(keys)):
            raise ValueError(f"duplicate key at line {node.start_mark.line + 1}")
        return super().construct_mapping(node, deep=deep)


def read_yaml(text: str) -> dict:
    return yaml.load(text, Loader=_Strict) or {}
