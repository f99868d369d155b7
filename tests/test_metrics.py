"""Clean, defective and unmet cases of the metrics on small recordings."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidegauge.model import SAMPLES, STREAMS
from tidegauge.operators import integrity, motion, sequences, timing


def recording(spark, values, dt=0.01, stream="s", channel="x", native=None):
    rows = [("e", stream, channel, i, None if (native or {}).get(i, 0) is None else int(i * dt * 1e6) + (native or {}).get(i, 0), i * dt, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SAMPLES)


def streams(spark, **change):
    row = {"episode_id": "e", "stream": "s", "taxonomy": "proprio.joint", "unit": "us", "scale": 1e-6, "regular": True, "certified": True, "ordered": True} | change
    return spark.createDataFrame([tuple(row.values())], STREAMS)


def one(df):
    return df.first()


def test_missing_counts_null_and_nan_but_not_infinity(spark):
    s = recording(spark, [1.0, None, float("nan"), float("inf")])
    assert one(integrity.missing_pct(s)).value == 50.0


def test_flatline_breaks_at_nulls(spark):
    assert one(integrity.flatline_pct(recording(spark, [1.0, 1.0, None, 1.0, 2.0, 3.0]))).value == pytest.approx(100 / 3)
    assert one(integrity.flatline_pct(recording(spark, [0.0, 1.0, 1.0, 0.0]))).reason == "two-valued switch"
    assert one(integrity.flatline_pct(recording(spark, [1.0]))).reason == "too few samples"


def test_longest_run_takes_the_first_of_equals(spark):
    r = one(sequences.longest_run(recording(spark, [1.0, 1.0, 2.0, 3.0, 3.0])))
    assert (r.start, r.length) == (1, 1)


def test_spike_needs_a_full_window(spark):
    v = [math.sin(i / 5) for i in range(101)]
    assert one(integrity.spike_pct(recording(spark, v))).value == 0
    v[50] += 50
    assert one(integrity.spike_pct(recording(spark, v))).value == pytest.approx(100 / 51)
    assert one(integrity.spike_pct(recording(spark, v[:50]))).reason == "too few samples"


def test_cadence_reasons_in_order(spark):
    s = recording(spark, [0.0] * 20)
    assert one(timing.effective_hz(s, streams(spark))).value == pytest.approx(100)
    assert one(timing.effective_hz(s, streams(spark, ordered=False, certified=False))).reason == "source row order unavailable"
    assert one(timing.effective_hz(s, streams(spark, certified=False, scale=None))).reason == "not a certified capture clock"
    assert one(timing.recorded_hz(s, streams(spark, certified=False, scale=None))).reason == "time unit unknown"
    assert one(timing.recorded_hz(recording(spark, [0.0] * 20, native={7: None}), streams(spark))).reason == "invalid timestamps"
    assert one(timing.recorded_hz(recording(spark, [0.0] * 20, native={7: -10000}), streams(spark))).reason == "non-positive gaps"
    assert one(timing.recorded_hz(s, streams(spark, regular=False))).reason == "not regular"


def test_violations_repeat_and_go_back(spark):
    s = recording(spark, [0.0] * 6, native={2: -10000, 4: -20000})
    assert one(timing.monotonic_violations(s, streams(spark))).value == 2
    assert [r.kind for r in timing.violation_rows(s, streams(spark)).orderBy("row_idx").collect()] == ["repeated", "backwards"]


def test_rows_that_share_a_number_are_each_a_violation(spark):
    """Rows of one number were taken for one row; other channels of a row still are."""
    t = [(0, 5), (1, 6), (1, 6), (1, 7), (2, 6)]
    s = spark.createDataFrame([("e", "s", c, i, n, n * 1e-6, 0.0) for c in "xy" for i, n in t], SAMPLES)
    assert sorted((r.row_idx, r.kind) for r in timing.violation_rows(s, streams(spark)).collect()) == [(1, "repeated"), (2, "backwards")]


def test_drop_rate_sees_a_hole(spark):
    rows = [r for r in recording(spark, [0.0] * 30).collect() if not 10 <= r.row_idx < 15]
    s = spark.createDataFrame(rows, SAMPLES)
    assert one(timing.drop_rate(s, streams(spark))).value == pytest.approx(5 / 30)


def test_vibration_share(spark):
    slow = [math.sin(2 * math.pi * 5 * i / 100) for i in range(100)]
    fast = [x + 0.5 * math.sin(2 * math.pi * 30 * i / 100) for i, x in enumerate(slow)]
    assert one(motion.hf_vibration_ratio(recording(spark, slow))).value < 1e-9
    assert one(motion.hf_vibration_ratio(recording(spark, fast))).value == pytest.approx(0.2, abs=1e-6)
    assert one(motion.hf_vibration_ratio(recording(spark, slow, dt=0.1))).reason == "sample rate too low"


def test_unwrap_steps_over_a_null(spark):
    v = [3.0, None, -3.0, -2.9]
    got = [r.unwrapped for r in sequences.unwrapped(recording(spark, v)).orderBy("row_idx").collect()]
    assert got[1] is None and got[2] == pytest.approx(2 * math.pi - 3)


def test_empty_recordings(spark):
    s = spark.createDataFrame([], SAMPLES)
    t = spark.createDataFrame([], STREAMS)
    from tidegauge.operators.registry import METRICS

    for m in METRICS.values():
        if m.family in ("timing", "integrity", "motion"):
            assert m.run(s, t).count() == 0, m.name


def test_a_band_of_nulls_overrides_the_default(spark):
    from tidegauge.plans import policy as P
    from tidegauge.plans import scoring as S

    rows = spark.createDataFrame([("e", "missing_pct", t, v, None) for t, v in (("a", 5.0), ("b", 5.0), ("a", 0.5), ("a", 2.75))], "episode_id string, metric string, taxonomy string, value double, reason string")
    p = P.extended(P.DEFAULT, {"missing_pct": {"taxonomies": {"b": (None, None)}}})
    got = {(r.taxonomy, r.value): (r.points, r.status) for r in S.resolve(rows, P.grades_table(spark, p), P.bands_table(spark, p)).collect()}
    assert got == {("a", 5.0): (0.0, "critical"), ("b", 5.0): (None, "report_only"), ("a", 0.5): (100.0, "good"), ("a", 2.75): (pytest.approx(50.0), "warning")}


def test_duplicate_yaml_keys_are_refused():
    from tidegauge.plans.policy import read_yaml

    with pytest.raises(ValueError, match="duplicate key"):
        read_yaml("a: 1\na: 2\n")


def test_binomial_bound():
    from tidegauge.operators.cohort import binomial_upper

    assert binomial_upper(0, 600) == pytest.approx(1 - 0.05 ** (1 / 600), abs=1e-9)
    assert binomial_upper(5, 5) == 1.0


def test_normalised_names():
    from tidegauge.functions.names import normalised

    assert normalised("observation.TCP_pose_x_mm") == "tcp_pose"
    assert normalised("x") == "x"


def test_timestamp_of_key(spark):
    from tidegauge.functions.names import timestamp_of_key

    got = spark.range(1).select(timestamp_of_key(F.lit("CAM12_2024-01-02-03h-04m-05s")).alias("t")).first().t
    assert got == 1704164645


def _odd(spark):
    """Channels with nulls, runs over the ends of parts, two values, one value, few rows; steps that vary."""
    import random

    r = random.Random(3)
    made = {
        "walk": [r.choice([1.0, 1.0, 2.0, 3.5, 7.25]) for _ in range(200)],
        "nulls": [None if r.random() < 0.3 or 40 <= i < 75 else r.random() for i in range(200)],
        "switch": [float(i // 9 % 2) for i in range(200)],
        "long": [r.random() if i < 50 or i > 120 else 4.0 for i in range(200)],
        "one": [0.1] * 200,
        "nan": [float("nan") if i in (13, 14) else r.random() for i in range(200)],
        "rest": [math.sin(i) * (1 if i < 150 else 1e-3) for i in range(200)],
        "few": [1.0, None, 3.0],
    }
    rows = [("e", "s" if c != "rest" else "q", c, i, i, i * 0.01 + (i % 3) * 1e-3, v) for c, x in made.items() for i, v in enumerate(x)]
    rows += [("e", "tiny", "x", i, i, i * 0.01, float(i)) for i in range(4)]
    return spark.createDataFrame(rows, SAMPLES)


ODD = {
    "mean_jerk_norm": motion.mean_jerk_norm,
    "max_abs_jerk": motion.max_abs_jerk,
    "log_dimensionless_jerk": motion.log_dimensionless_jerk,
    "still_drift": motion.still_drift,
    "flatline_pct": integrity.flatline_pct,
    "snr_db": integrity.snr_db,
    "longest_run": lambda s, _: sequences.longest_run(s),
}


@pytest.mark.parametrize("name", sorted(ODD))
def test_parts_of_a_channel_give_what_the_whole_gives(spark, name):
    """However a channel is parted; and no window is over a whole channel's rows."""
    s = _odd(spark)
    st = streams(spark).unionByName(streams(spark, stream="q")).unionByName(streams(spark, stream="tiny"))
    table = lambda df: {tuple(r[:3]) if "channel" in df.columns else tuple(r[:2]): tuple(float(f"{x:.11g}") if isinstance(x, float) else x for x in r[2:]) for r in df.collect()}
    whole = table(ODD[name](s, st))
    assert len(whole) >= 3
    for size in (1, 2, 7, 50):
        parts = ODD[name](s.withColumn("chunk", F.floor(F.col("row_idx") / size)), st)
        assert table(parts) == whole, size
    assert "windowspecdefinition(episode_id" in (plan := parts._jdf.queryExecution().optimizedPlan().toString()) and "chunk" in plan


def test_metrics_of_parts_equal_plain_sums(spark):
    import statistics

    s = _odd(spark)
    v = {}
    for r in s.orderBy("row_idx").collect():
        v.setdefault((r.stream, r.channel), []).append((r.t, r.v))
    dt = statistics.median(b[0] - a[0] for (st, _), x in v.items() if st == "q" for a, b in zip(x, x[1:]))
    x = [b for _, b in v["q", "rest"]]
    d3 = [d - 3 * c + 3 * b - a for a, b, c, d in zip(x, x[1:], x[2:], x[3:])]
    want = math.sqrt(sum(d * d for d in d3) / len(d3)) / statistics.pstdev(x) / dt**3
    st = streams(spark, stream="q")
    p = s.withColumn("chunk", F.floor(F.col("row_idx") / 7))
    assert one(motion.mean_jerk_norm(p, st)).value == pytest.approx(want)
    assert one(motion.max_abs_jerk(p, st)).value == pytest.approx(max(map(abs, d3)) / statistics.pstdev(x) / dt**3)
    r = {r.channel: r for r in sequences.longest_run(p).collect()}
    assert (r["long"].start, r["long"].stop, r["long"].length) == (51, 120, 70) and (r["one"].start, r["one"].length) == (1, 199)
    q = {r.channel: r for r in integrity.flatline_pct(p).collect()}
    assert q["switch"].reason == "two-valued switch" and q["one"].value == 100.0
