"""Reading, inference, grading, defects, comparing and compact reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidegauge.plans import defects as X
from tidegauge.plans import grade as G
from tidegauge.sources import lerobot, tabular, walk


@pytest.fixture
def arm(tmp_path):
    lines = ["t_ms,id,tcp_pose_x_mm,tcp_pose_y_mm"] + [f"{i * 10},{arm},{i % 7}.5,{i * 2}" for i in range(40) for arm in ("armA", "armB")]
    p = tmp_path / "arm.csv"
    p.write_text("\n".join(lines))
    return str(p)


def test_csv_is_inferred(spark, arm):
    assert walk.select(spark, arm).name == "csv"
    df = tabular.read_csv(spark, arm)
    s = tabular.infer(df)
    assert (s.time, s.unit, s.entity) == ("t_ms", "ms", "id")
    assert [r[0] for r in df.orderBy(tabular.ROW).select(tabular.ROW).collect()] == list(range(80))
    samples = tabular.read(spark, arm)
    assert samples.count() == 160
    assert {r.stream for r in samples.select("stream").distinct().collect()} == {"tcp_pose[armA]", "tcp_pose[armB]"}


def test_delimited_names_come_from_a_comment(spark, tmp_path):
    p = tmp_path / "pose.txt"
    p.write_text("# made by hand\n# timestamp ax note\n" + "\n".join(f"{i * 0.02:.2f} {i}.5 7" for i in range(30)))
    df = tabular.read_delimited(spark, str(p))
    assert df.columns == [tabular.ROW, "timestamp", "ax", "note"]
    assert dict(df.dtypes)["ax"] == "double"
    assert tabular.infer(df).time == "timestamp"


def test_json_lines_are_known_by_content(spark, tmp_path):
    p = tmp_path / "imu.txt"
    p.write_text("\n".join(json.dumps({"t_us": i * 5000, "acc": [i, 1.5, 2], "pose": {"x": i / 3}}) for i in range(20)))
    assert walk.select(spark, str(p)).name == "jsonl"
    df = tabular.read_jsonl(spark, str(p))
    assert set(df.columns) == {tabular.ROW, "t_us", "acc_0", "acc_1", "acc_2", "pose.x"}
    assert tabular.infer(df).unit == "us"


def test_json_keyed_by_time(spark, tmp_path):
    p = tmp_path / "index.json"
    p.write_text(json.dumps({f"CAM_{i}_2024-01-02-03h-04m-{5 * i:02d}s": {"s1": {"gain": i}, "s2": {"gain": 2 * i}} for i in range(5)}))
    df = tabular.read_json(spark, str(p))
    assert df.count() == 10 and {"timestamp_s", "device_id", "gain"} <= set(df.columns)


def test_no_time_axis_is_refused(spark, tmp_path):
    p = tmp_path / "meta.json"
    p.write_text(json.dumps({"fps": 30, "codec": "h264", "duration_sec": 2.5}))
    with pytest.raises(tabular.UnresolvedSource):
        tabular.infer(tabular.read_json(spark, str(p)))


def test_walk_tells_empty_and_hidden(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "data" / "b.csv").write_text("")
    got = {r.path.rsplit("/", 1)[1]: r.state for r in walk.listing(spark, str(tmp_path / "data")).collect()}
    assert got == {"a.csv": "candidate", "b.csv": "empty"}
    assert walk.within_limits(walk.listing(spark, str(tmp_path / "data")), max_files=1) == (False, 2, 8)


def test_tree_of_episodes(spark, tmp_path):
    root = tmp_path / "set"
    (root / "meta").mkdir(parents=True)
    (root / "meta" / "info.json").write_text(json.dumps({"codebase_version": "v2.1", "fps": 30}))
    (root / "meta" / "episodes.jsonl").write_text("\n".join(json.dumps({"episode_index": e, "tasks": ["pick"], "length": 8}) for e in (0, 2)))
    rows = spark.range(14).select(F.when(F.col("id") < 8, 0).otherwise(1).cast("bigint").alias("episode_index"), (F.col("id") % 8).alias("frame_index"), ((F.col("id") % 8) / 30).cast("float").alias("timestamp"), F.col("id").alias("index"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("observation.state"))
    rows.write.parquet(str(root / "data"))
    got = {r.episode_index: r.state for r in lerobot.episodes(spark, str(root)).collect()}
    assert got == {0: "found", 1: "not in metadata", 2: "no rows"}
    s = lerobot.samples(spark, str(root))
    assert s.count() == 28 and s.where("episode_id = '0'").count() == 16
    assert lerobot.reconstructed_clock(lerobot.data(spark, str(root)), 30.0)
    with pytest.raises(ValueError, match="names"):
        lerobot.checked_template("data/{chunk}/{nonsense}.parquet", ("chunk",))


def test_grading_a_file(spark, arm, tmp_path):
    g = G.grade(spark, arm)
    assert {r.decision for r in g.decisions.collect()} <= {"pass", "review", "unknown", "blocked"}
    assert "pass" in g.card()
    g.write(str(tmp_path / "report"))
    old = spark.read.parquet(str(tmp_path / "report" / "results"))
    diff = {r.state: r["count"] for r in G.compare(old, old.withColumn("value", F.when(F.col("metric") == "drift", F.col("value") + 1).otherwise(F.col("value")))).groupBy("state").count().collect()}
    assert set(diff) == {"same", "changed"}
    with pytest.raises(ValueError, match="ambiguous"):
        G.compare(old.union(old), old)


def test_each_defect_is_seen_by_its_metric(spark):
    names = tuple(dict.fromkeys(m for _, m in X.DEFECTS.values()))
    got = {(r.defect, r.metric): (r.clean, r.value) for r in X.detection(X.clean_recording(spark, rows=200), names).collect()}
    for defect, (_, name) in X.DEFECTS.items():
        clean, value = got[defect, name]
        assert value is not None and abs(value - (clean or 0)) > 1e-3, (defect, clean, value)


def test_compact_json_round_trip():
    records = [{"metric": "a", "value": 1.5, "nested": {"metric": "b"}}, {"metric": "c"}]
    assert G.read_compact(G.compact_json(records)) == records
    assert G.without_defaults({"a": "", "b": {"c": None}, "d": 0}) == {"d": 0}


def test_grading_a_tree_with_its_contracts(spark, tmp_path):
    root = tmp_path / "set"
    (root / "meta").mkdir(parents=True)
    features = {"observation.state": {"dtype": "float32"}, "action": {"dtype": "float32"}, "observation.image": {"dtype": "video"}}
    (root / "meta" / "info.json").write_text(json.dumps({"codebase_version": "v2.1", "fps": 30, "features": features}))
    (root / "meta" / "episodes.jsonl").write_text("\n".join(json.dumps({"episode_index": e, "tasks": tasks, "length": 8}) for e, tasks in ((0, ["pick"]), (2, []))))
    rows = spark.range(14).select(F.when(F.col("id") < 8, 0).otherwise(1).cast("bigint").alias("episode_index"), (F.col("id") % 8).alias("frame_index"), ((F.col("id") % 8) / 30).cast("float").alias("timestamp"), F.col("id").alias("index"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("observation.state"))
    rows.write.parquet(str(root / "data"))
    assert walk.kind(spark, str(root)) == "tree"
    assert lerobot.declared(spark, str(root)) == {"observation.state": "float32", "action": "float32"}
    g = G.grade(spark, str(root), metrics=("missing_pct", "effective_hz", "recorded_hz"))
    got = {(r.metric, r.episode_id): r.value for r in g.results.where("stream = ''").collect()}
    assert [got["episode_not_in_metadata", e] for e in "012"] == [0.0, 1.0, 0.0]
    assert got["index_range_mismatch_count", "0"] == 0.0 and got["index_range_mismatch_count", "2"] is None
    assert got["task_instruction_missing", "0"] == 0.0 and got["task_instruction_missing", "2"] == 1.0
    assert got["feature_mismatch_count", "0"] == 1.0  # action has no column
    assert {r.episode_id: r.decision for r in g.decisions.collect()} == {e: "blocked" for e in "012"}
    # stamps are frame numbers over the rate: no clock of the recording's own
    assert g.results.where("metric = 'effective_hz' AND value IS NOT NULL").isEmpty()
    assert g.results.where("metric = 'recorded_hz' AND episode_id = '0'").first().value == pytest.approx(30, rel=1e-4)


def test_grading_a_folder_file_by_file(spark, arm, tmp_path):
    root = tmp_path / "many"
    (root / "left").mkdir(parents=True)
    text = open(arm).read()
    (root / "a.csv").write_text(text)
    (root / "left" / "a.csv").write_text(text)
    (root / "empty.csv").write_text("")
    (root / "notes.md").write_text("no recording")
    samples, without = tabular.read_folder(spark, str(root))
    assert {r.episode_id: r["count"] for r in samples.groupBy("episode_id").count().collect()} == {"a.csv": 160, "left/a.csv": 160}
    assert {r.path: r.reason.rsplit(": ", 1)[-1] for r in without.collect()} == {"empty.csv": "empty", "notes.md": "no adapter reads it"}
    g = G.grade(spark, str(root), metrics=("missing_pct", "drift"))
    assert {r.episode_id for r in g.decisions.collect()} == {"a.csv", "left/a.csv"}
    with pytest.raises(tabular.UnresolvedSource, match="limits"):
        tabular.read_folder(spark, str(root), max_files=3)
    with pytest.raises(FileNotFoundError):
        walk.kind(spark, str(root / "nowhere"))
    (root / "none").mkdir()
    assert tabular.read_folder(spark, str(root / "none"))[0].isEmpty()


def test_a_saved_report_is_read_again_and_agrees(spark, arm, tmp_path):
    path = str(tmp_path / "report")
    G.grade(spark, arm, metrics=("missing_pct", "drift", "flatline_pct")).write(path)
    g = G.load(spark, path)
    assert "pass" in g.card() and G.disagreements(g).isEmpty()
    torn = G.Grading(g.results, g.findings.limit(0), g.scores.withColumn("score", F.lit(101.0)), g.decisions.union(g.decisions), g.coverage)
    flagged = g.results.where("status IN ('warning', 'critical')").count()
    got = {r.rule: r["count"] for r in G.disagreements(torn).groupBy("rule").count().collect()}
    assert got.get("a flagged result without its finding", 0) == flagged
    assert got["a score out of range"] == got["an episode decided twice"] == 1
