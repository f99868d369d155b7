"""Requirements, stuck channels, targets, names and scopes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import names
from tidegauge.operators import dictionary as N
from tidegauge.operators import gates
from tidegauge.operators.registry import METRICS
from tidegauge.plans import eligibility as E
from tidegauge.plans import grade as G
from tidegauge.plans import policy as P

STREAMS = "episode_id string, stream string, taxonomy string, unit string, scale double, regular boolean, certified boolean, ordered boolean"


@pytest.fixture(scope="module")
def recording(spark):
    """Sixty rows at 50 Hz of a joint that moves, one that never does, and an unmapped stream."""
    rows = []
    for i in range(60):
        t = i * 20_000_000
        rows += [("e", "joint_position", "a", i, t, t / 1e9, float(i % 7)), ("e", "joint_position", "b", i, t, t / 1e9, 1.5), ("e", "what", "a", i, t, t / 1e9, float(i))]
    samples = spark.createDataFrame(rows, "episode_id string, stream string, channel string, row_idx long, native long, t double, v double")
    streams = spark.createDataFrame([("e", "joint_position", "proprio.joint_position", "ns", 1e-9, True, True, True), ("e", "what", "unmapped.what", "ns", 1e-9, True, True, True)], STREAMS)
    return samples, streams


@pytest.fixture(scope="module")
def graded(recording):
    metrics = ("flatline_pct", "effective_hz", "dead_taxel_pct", "p99_torque", "still_drift", "limit_proximity_pct")
    needed = E.Requirements(families=("integrity",), capabilities=("video_quality",))
    g = G.grade_samples(*recording, metrics=metrics, targets={"effective_hz": 50.0}, needed=needed)
    return {(r.stream, r.channel, r.metric): r for r in g.results.collect()}, g.decisions.first()


def test_a_channel_that_never_changed_is_a_warning(graded):
    r = graded[0]["joint_position", "b", "flatline_pct"]
    assert (r.value, r.points, r.status) == (100.0, 50.0, "warning")
    assert graded[0]["joint_position", "a", "flatline_pct"].status == "good"


def test_metrics_run_on_the_streams_they_are_of(graded):
    found, _ = graded
    assert found["joint_position", "", "dead_taxel_pct"].availability == "not_applicable"
    assert found["what", "", "dead_taxel_pct"].availability == "unavailable"
    assert found["joint_position", "a", "p99_torque"].value is None
    assert found["what", "a", "p99_torque"].reason.startswith("needs one of proprio.joint_torque")
    assert found["joint_position", "a", "limit_proximity_pct"].availability == "computed"


def test_a_target_makes_a_deviation_gradable(graded):
    r = graded[0]["joint_position", "", "effective_hz"]
    assert r.value == pytest.approx(50.0) and r.status == "good"


def test_unmet_requirements_leave_an_episode_unknown(graded):
    assert graded[1].decision == "unknown" and graded[1].n_reasons >= 1


def test_every_metric_has_a_label_and_its_needs(spark):
    table = {r.metric: r for r in gates.requirements(spark).collect()}
    assert set(table) == set(METRICS) and all(m.label for m in METRICS.values())
    assert (table["still_drift"].least, table["velocity_spike_pct"].least, table["hf_vibration_ratio"].least) == (8, 40, 32)
    assert list(table["hysteresis"].needs) == ["extero.taxel_pressure"]


def test_one_stream_is_selected_or_none(recording):
    _, streams = recording
    assert gates.select_one(streams, stream="what").count() == 1
    with pytest.raises(ValueError, match="more than one"):
        gates.select_one(streams, episode_id="e")
    with pytest.raises(ValueError, match="no stream"):
        gates.select_one(streams, stream="none")


def test_the_metadata_tier_reads_nothing(recording):
    _, streams = recording
    rows = gates.skipped(streams, list(METRICS.values())[:3]).collect()
    assert len(rows) == 6 and {r.availability for r in rows} == {"skipped"}


def test_two_assertions_for_one_channel_are_an_error(spark):
    channels = spark.createDataFrame([("f", 0, "s")], "feature string, index long, source string")
    twice = spark.createDataFrame([("f", 0, None, "a"), ("f", 0, "s", "b")], "feature string, index long, source string, taxonomy string")
    with pytest.raises(Exception, match="more than one assertion"):
        N.asserted(channels, twice).collect()


def test_columns_of_a_file():
    assert N.grouped_by_stem(["t", "accel_x", "accel_y", "x", "y", "gyro_z"], "pose") == {"t": ["t"], "accel": ["accel_x", "accel_y"], "pose": ["x", "y"], "gyro": ["gyro_z"]}
    assert N.axes_of(["power_w"]) == {"power_w": None}
    assert N.axes_of(["q_x", "q_w"]) == {"q_x": "x", "q_w": "w"}
    assert N.axes_of(["f.0", "f.1", "f.2"], array=True) == {"f.0": "x", "f.1": "y", "f.2": "z"}
    assert N.ordered_by_axis(["n", "p_10", "p_2", "p_z", "p_x"], {"p_10": "10", "p_2": "2", "p_z": "z", "p_x": "x"}) == ["p_x", "p_z", "p_2", "p_10", "n"]
    assert N.is_quaternion(["rot.qx", "rot.qy", "rot.qz", "rot.qw"]) and not N.is_quaternion(["qx", "qx", "qz", "qw"])
    assert N.task_list([b"fold", ["the", None], "towel", 3]) == ["fold", "the", "towel", "3"]
    assert N.declared_names({"motors": [["a", "b"], ["c"]]}) == ["a", "b", "c"]
    assert N.resolve_feature("state", ["a.pos", "b.pos"], {"a.pos": "p", "b.pos": "p"}) == "p"
    assert N.resolve_feature("state", ["a.pos", "b"], {"a.pos": "p"}) == "unmapped.state"


def test_a_dictionary_is_read_from_a_file(tmp_path, spark):
    path = tmp_path / "d.yaml"
    path.write_text("entries:\n  a.b:\n    aliases: [foo]\n    namespace_aliases: [grip]\n    channel_patterns:\n      - {features: ['state*'], names: ['*.pos'], exclude: ['*hand*']}\n")
    entries = N.read_dictionary(str(path))
    rows = spark.createDataFrame([("x.foo_mm",), ("grip.left.3",), ("none",), (None,)], "name string")
    assert {r.name: r.taxonomy for r in N.resolve_names(rows, N.alias_table(spark, entries)).collect()} == {"x.foo_mm": "a.b", "grip.left.3": "a.b", "none": None}
    assert spark.range(1).select(N.match_channel(F.lit("STATE.left"), F.lit("arm.pos"), entries), N.match_channel(F.lit("state"), F.lit("hand.pos"), entries)).first()[:] == ("a.b", None)


def test_units_and_times_of_names(spark):
    rows = spark.createDataFrame([("t_msec", "run+2023-07-07-10h-00m-34s"), ("t[nsec]", "x-2023-07-07T10:00:34"), ("t_in_us", "none"), ("plain", None)], "n string, k string")
    got = rows.select(names.unit_of_name(F.col("n")), names.timestamp_of_key(F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("ms", 1688724034), ("ns", 1688724034), ("us", None), (None, None)]


def test_scopes_and_targets():
    seen = {g.metric: g for g in E.scoped(P.DEFAULT, E.Requirements(), everywhere=("frames_readable",))}
    assert seen["sharpness_score"].report_only and not seen["frames_readable"].report_only and not seen["spike_pct"].report_only
    video = {g.metric: g for g in E.scoped(P.DEFAULT, E.Requirements(capabilities=("video_quality",)), {"video_quality": {"spike_pct": {"good": 1.0}}})}
    assert not video["sharpness_score"].report_only and video["spike_pct"].good == 1.0
    assert E.declared_targets({"effective_hz": "fps", "x": "none", "y": "flag"}, {"fps": 30, "flag": True}) == {"effective_hz": 30.0}


def test_an_episode_is_in_the_file_that_its_index_names(spark):
    from tidegauge.operators import contracts as C

    index = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "episode_id string, file string")
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "episode_id string, file string")
    got = {r.episode_id: (r.value, r.reason) for r in C.episode_file_mismatch(index, rows).collect()}
    assert got == {"a": (0.0, None), "b": (1.0, None), "c": (None, "no file is named")}


@pytest.mark.parametrize("kind", ["long", "string", "timestamp"])
def test_strided_episodes_are_numbered_by_ranges(spark, kind):
    """Places of one order without a window over all rows; nulls first, ties and odd sizes as before."""
    from pyspark.sql import functions as F

    from tidegauge.plans import eligibility as E

    for n in (0, 1, 29, 30, 1000, 20011):
        df = spark.range(n).select(F.when(F.col("id") % 97 > 0, F.col("id") * 7919 % 20011).alias("k")).withColumn("k", F.timestamp_seconds("k") if kind == "timestamp" else F.col("k").cast(kind))
        got = E.strided(df, "k", 30)
        order = [r.k for r in df.orderBy("k").collect()]
        step = max(1, n // 30)
        want = [x for i, x in enumerate(order) if i % step == 0 and i < step * 30]
        assert sorted((r.k for r in got.collect()), key=str) == sorted(want, key=str)
    assert kind == "timestamp" or "SinglePartition" not in got._jdf.queryExecution().toString()


def test_numbers_by_ranges_equal_one_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidegauge.operators.places import numbered

    df = spark.range(30000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 9973).alias("k"), "id")
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    want = df.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")) - 1)
    got = numbered(df, ["g"], ["k", "id"], "p")
    assert got.select("chunk").distinct().count() > 50
    assert got.select("g", "k", "id", "p").exceptAll(want.select("g", "k", "id", F.col("p").cast("bigint"))).isEmpty() and got.count() == 30000
