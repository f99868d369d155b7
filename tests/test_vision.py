"""Pixel kernels and camera rules."""

from __future__ import annotations

import numpy as np
import pytest

from tidegauge.operators import vision as V

FRAMES = "episode_id string, camera string, frame_idx bigint, pts double, width int, height int, gray binary"


def frames(spark, images):
    rows = [("e", "c", i, i / 10, x.shape[1], x.shape[0], bytearray(x.astype(np.uint8).tobytes())) for i, x in enumerate(images)]
    return spark.createDataFrame(rows, FRAMES)


def test_kernels():
    x = np.zeros((7, 7), np.uint8)
    x[3, 3] = 10
    lap = V.laplacian(x)
    assert lap[2, 2] == -40 and lap[2, 1] == 10 and lap.sum() == 0
    assert V.box3(x).sum() == 90
    assert np.isnan(V.sharpness_loss(np.full((8, 8), 7)))
    assert V.block_means(np.arange(64).reshape(8, 8), 2).tolist() == [[13.5, 17.5], [45.5, 49.5]]


def test_blur_lowers_sharpness(spark):
    rng = np.random.default_rng(0)
    sharp = rng.integers(0, 255, (40, 40))
    soft = V.box3(V.box3(sharp)) / 81
    a, b = (V.sharpness_score(V.frame_stats(frames(spark, [x, x]))).first().value for x in (sharp, soft))
    assert a > 0.74 > b


def test_blank_dark_bright_and_broken_frames(spark):
    rng = np.random.default_rng(0)
    good = rng.integers(60, 200, (40, 40))
    df = frames(spark, [good, np.full((40, 40), 90), np.zeros((40, 40)), np.full((40, 40), 255)])
    stats = V.frame_stats(df)
    assert V.blank_frame_pct(stats).first().value == 75
    assert V.dark_frame_pct(stats).first().value == 25
    assert V.bright_frame_pct(stats).first().value == 25
    broken = V.frame_stats(spark.createDataFrame([("e", "c", 0, 0.0, 4, 4, bytearray(b"123")), ("e", "c", 1, 0.1, 4, 4, None)], FRAMES))
    assert V.exposure_level(broken).first().reason == "no decoded frames"
    assert V.corrupt_frame_pct(V.frame_stats(frames(spark, [good[:20, :20]]))).first().reason == "frame too small"


def test_frozen_only_while_the_control_moves(spark):
    rng = np.random.default_rng(1)
    moving = [rng.integers(0, 255, (32, 32)) for _ in range(20)]
    images = moving[:10] + [moving[9]] * 10 + moving[10:]
    changes = V.frame_changes(V.frame_stats(frames(spark, images)))
    control = lambda f: spark.createDataFrame([("e", i, f(i)) for i in range(30)], "episode_id string, frame_idx bigint, step double")
    assert V.frozen_frame_pct(changes, V.moving_frames(control(lambda i: 1.0))).first().value == pytest.approx(100 * 10 / 29)
    assert V.frozen_frame_pct(changes, V.moving_frames(control(lambda i: float(not 10 <= i < 20)))).first().value == 0


def test_stamps(spark):
    pts = [0.0, 0.1, 0.2, 0.2, 0.3, 0.7]
    df = spark.createDataFrame([("e", "c", i, p) for i, p in enumerate(pts)], "episode_id string, camera string, frame_idx bigint, pts double")
    assert V.pts_defect_pct(df).first().value == pytest.approx(40)
    assert V.max_gap_s(df).first().value == pytest.approx(0.4)
    assert V.max_gap_s(df.limit(1)).first().reason == "too few packets"


HEADERS = "episode_id string, camera string, opens boolean, first_decodes boolean, frames_decode boolean, width int, height int, fps double, codec string, pix_fmt string"


def test_headers_against_declaration_and_delivery(spark):
    headers = spark.createDataFrame(
        [
            ("e", "good", True, True, True, 640, 480, 29.99, "h264", "yuv420p"),
            ("e", "small", True, True, False, 320, 240, 15.0, "mjpeg", "yuv420p"),
            ("e", "shut", False, None, None, None, None, None, None, None),
        ],
        HEADERS,
    )
    declared = spark.createDataFrame([("e", "good", 640, 480, 30.0, None), ("e", "small", 640, 480, 30.0, "rgb24")], "episode_id string, camera string, width int, height int, fps double, pix_fmt string")
    at = lambda df: {r.camera: (r.value, r.reason) for r in df.collect()}
    assert at(V.camera_stream_present(headers)) == {"good": (1.0, None), "small": (1.0, None), "shut": (0.0, None)}
    assert at(V.frames_readable(headers)) == {"good": (1.0, None), "small": (0.0, None), "shut": (None, "the file doesn't open")}
    assert at(V.video_format_consistency(headers, declared)) == {"good": (0.0, None), "small": (4.0, None), "shut": (0.0, None)}
    assert at(V.delivery_spec_met(headers, width=640, height=480, fps=30.0, codecs=("h264",))) == {"good": (1.0, None), "small": (0.0, None), "shut": (0.0, None)}


CHANGES = "episode_id string, camera string, frame_idx bigint, pts double, change double"


def test_a_picture_that_jumps_where_the_control_does_not(spark):
    def found(at, control_too, n=60):
        changes = spark.createDataFrame([("e", "c", i, i / 10, 100.0 if i == at else 1.0 + i % 2) for i in range(n)], CHANGES)
        controls = spark.createDataFrame([("e", "c", i, 100.0 if control_too and i == at else 1.0) for i in range(n)], "episode_id string, camera string, frame_idx bigint, ratio double")
        return V.dropped_chunk_count(changes, controls).first()

    assert found(30, False).value == 1.0
    assert found(30, True).value == 0.0
    assert found(4, False).value == 0.0  # within ten steps of the start
    assert found(10, False, n=20).reason == "too few steps"
    jumps = spark.createDataFrame([("e", 30, 9.0), ("e", 12, 5.0)], "episode_id string, frame_idx bigint, z double")
    changes = spark.createDataFrame([("e", "c", i, i / 10, 100.0 if i == 30 else 1.0 + i % 2) for i in range(60)], CHANGES)
    assert V.cut_count(changes, jumps).first().value == 1.0


def test_lag_of_the_picture_behind_the_control(spark):
    x = np.random.default_rng(2).normal(size=200)
    for shift in (0, 3):
        rows = [("e", "c", k, float(x[k]), float(x[k - shift])) for k in range(shift, 200)]
        pairs = spark.createDataFrame(rows, "episode_id string, camera string, k bigint, x double, y double")
        assert V.video_control_lag_ms(pairs, 0.1).first().value == pytest.approx(100 * shift, abs=30)
    short = spark.createDataFrame(rows[:2], "episode_id string, camera string, k bigint, x double, y double")
    assert V.video_control_lag_ms(short, 0.1).first().reason == "too little overlap"
