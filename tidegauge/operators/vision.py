"""Camera metrics: one pass over pixels, then expressions over its statistics.

``frames``: episode_id, camera, frame_idx, pts (s), width, height, gray (one byte
a pixel, row by row).  Decoding is a source's business; frames come decoded.
``frame_stats`` reads each frame once, without its neighbours, so that frames
of one recording may lie on any executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import first_reason, results
from .registry import metric

CAMERA = ("episode_id", "camera")

# Limits of the frame rules.
BLANK_SPREAD = 5
CORRUPT_NOISE, CORRUPT_NATIVE_SPREAD, CORRUPT_SIDE = 5.0, 32, 32
DARK_LEVEL, WHITE_LEVEL, DARK_P95, SHARE = 5, 250, 40, 0.5
SHIFT_SHARE, SHIFT_LEAST, CLIPPED = 0.35, 20.0, 0.20
STILL_SCENE, STILL_SECONDS = 3.0, 5.0
FREEZE_SECONDS, FREEZE_FLOOR = 0.5, 0.10
MOVING_SHARE = 0.05
CUT_RATIO, CHUNK_RATIO, EDGE_STEPS = 3.6, 9.9, 10

STATS = "episode_id string, camera string, frame_idx bigint, pts double, width int, height int, mean double, p5 double, p95 double, dark double, white double, noise double, native_spread double, laplacian double, loss double, luma string, thumb array<float>"


def laplacian(image: np.ndarray) -> np.ndarray:
    """The four-neighbour kernel on interior pixels."""
    x = image.astype(np.float32)
    return x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]


def box3(image: np.ndarray) -> np.ndarray:
    """Sums of 3 by 3 pixels."""
    x = image.astype(np.float32)
    rows = x[:-2] + x[1:-1] + x[2:]
    return rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]


def sharpness_loss(image: np.ndarray) -> float:
    """The share of edge variance that another blur takes away; NaN for a flat image."""
    if min(image.shape) < 5:
        return float("nan")
    before = float(laplacian(image).var())
    return 1 - float(laplacian(box3(image)).var()) / 81 / before if before > 0 else float("nan")


def block_means(image: np.ndarray, side: int) -> np.ndarray:
    """The image as side by side means; a smaller image as it is."""
    h, w = image.shape
    if h < side or w < side:
        return image.astype(np.float32)
    return image[: h - h % side, : w - w % side].reshape(side, h // side, side, w // side).mean((1, 3)).astype(np.float32)


def _frame(image: np.ndarray) -> list:
    if not image.size:
        return [None] * 9 + [hashlib.sha256(b"").hexdigest(), []]
    p5, p95 = np.percentile(image, (5, 95))
    var = float(image.var())
    edge = float(laplacian(image).var()) if min(image.shape) >= 3 else float("nan")
    return [float(image.mean()), float(p5), float(p95), float((image <= DARK_LEVEL).mean()), float((image >= WHITE_LEVEL).mean()), edge / var if var > 0 else 0.0, float(p95 - p5), edge, sharpness_loss(image), hashlib.sha256(image.tobytes()).hexdigest(), block_means(image, 16).ravel().tolist()]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["mean", "p5", "p95", "dark", "white", "noise", "native_spread", "laplacian", "loss", "luma", "thumb"]
    kinds = [pa.float64()] * 9 + [pa.string(), pa.list_(pa.float32())]
    for batch in batches:
        found = []
        for raw, w, h in zip(batch.column("gray").to_pylist(), batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True):
            whole = raw is not None and w and h and len(raw) == w * h
            found.append(_frame(np.frombuffer(raw, np.uint8).reshape(h, w) if whole else np.zeros((0, 0), np.uint8)))
        made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
        keep = ["episode_id", "camera", "frame_idx", "pts", "width", "height"]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *made], names=[*keep, *names])


def frame_stats(frames: DataFrame) -> DataFrame:
    """Statistics of each frame; a frame whose bytes are not width * height has null ones."""
    return frames.select("episode_id", "camera", "frame_idx", "pts", "width", "height", "gray").mapInArrow(_stats, STATS)


def _share(stats: DataFrame, name: str, flag: Column) -> DataFrame:
    out = stats.groupBy(*CAMERA).agg(F.count("mean").alias("n"), (100 * F.avg(F.when(F.col("mean").isNotNull(), flag.cast("double")))).alias("value"))
    return results(out, CAMERA, name, "%", F.col("value"), first_reason((F.col("n") < 1, "no decoded frames")))


def _middle(stats: DataFrame, name: str, unit: str, column: str) -> DataFrame:
    x = F.when(~F.isnan(column), F.col(column))
    out = stats.groupBy(*CAMERA).agg(F.count(x).alias("n"), F.median(x).alias("value"))
    return results(out, CAMERA, name, unit, F.col("value"), first_reason((F.col("n") < 1, "no decoded frames")))


def is_blank() -> Column:
    return F.col("p95") - F.col("p5") < BLANK_SPREAD


@metric("sharpness_score", level="camera", family="vision", unit="fraction")
def sharpness_score(stats: DataFrame) -> DataFrame:
    return _middle(stats, "sharpness_score", "fraction", "loss")


@metric("exposure_level", level="camera", family="vision", unit="gray")
def exposure_level(stats: DataFrame) -> DataFrame:
    return _middle(stats, "exposure_level", "gray", "mean")


@metric("contrast_score", level="camera", family="vision", unit="gray")
def contrast_score(stats: DataFrame) -> DataFrame:
    return _middle(stats.withColumn("_c", F.col("p95") - F.col("p5")), "contrast_score", "gray", "_c")


@metric("exposure_shift_pct", level="camera", family="vision", unit="%")
def exposure_shift_pct(stats: DataFrame) -> DataFrame:
    """Frames far darker or brighter than the camera's middle, clipped far more than usual, or without spread."""
    usual = stats.groupBy(*CAMERA).agg(F.median("mean").alias("_m"), F.median("dark").alias("_d"), F.median("white").alias("_w"))
    far = F.greatest(SHIFT_SHARE * F.col("_m"), F.lit(SHIFT_LEAST))
    flag = (F.abs(F.col("mean") - F.col("_m")) > far) | (F.col("dark") - F.col("_d") > CLIPPED) | (F.col("white") - F.col("_w") > CLIPPED) | is_blank()
    return _share(stats.join(usual, list(CAMERA)), "exposure_shift_pct", flag)


@metric("blank_frame_pct", level="camera", family="vision", unit="%")
def blank_frame_pct(stats: DataFrame) -> DataFrame:
    return _share(stats, "blank_frame_pct", is_blank())


@metric("corrupt_frame_pct", level="camera", family="vision", unit="%")
def corrupt_frame_pct(stats: DataFrame) -> DataFrame:
    """Blank, or noisier than a picture can be; smaller frames than 32 pixels aren't judged."""
    flag = is_blank() | ((F.col("noise") >= CORRUPT_NOISE) & (F.col("native_spread") >= CORRUPT_NATIVE_SPREAD))
    out = stats.groupBy(*CAMERA).agg(F.count("mean").alias("n"), F.min(F.least("width", "height")).alias("side"), (100 * F.avg(flag.cast("double"))).alias("value"))
    return results(out, CAMERA, "corrupt_frame_pct", "%", F.col("value"), first_reason((F.col("n") < 1, "no decoded frames"), (F.col("side") < CORRUPT_SIDE, "frame too small")))


@metric("dark_frame_pct", level="camera", family="vision", unit="%")
def dark_frame_pct(stats: DataFrame) -> DataFrame:
    return _share(stats, "dark_frame_pct", (F.col("dark") >= SHARE) | (F.col("p95") <= DARK_P95))


@metric("bright_frame_pct", level="camera", family="vision", unit="%")
def bright_frame_pct(stats: DataFrame) -> DataFrame:
    return _share(stats, "bright_frame_pct", F.col("white") >= SHARE)


def _steps(packets: DataFrame) -> DataFrame:
    w = Window.partitionBy(*CAMERA).orderBy("pts", "frame_idx")
    return packets.where("pts IS NOT NULL").withColumn("step", F.col("pts") - F.lag("pts").over(w))


@metric("frame_count_vs_timebase", level="camera", family="vision", unit="fraction")
def frame_count_vs_timebase(packets: DataFrame, timestamps: DataFrame) -> DataFrame:
    """|packets - timestamps| over timestamps; timestamps: episode_id, camera, n."""
    n = packets.groupBy(*CAMERA).agg(F.count("*").alias("packets"))
    out = timestamps.join(n, list(CAMERA), "left").fillna({"packets": 0})
    return results(out, CAMERA, "frame_count_vs_timebase", "fraction", F.abs(F.col("packets") - F.col("n")) / F.col("n"), first_reason((F.coalesce("n", F.lit(0)) < 1, "no timestamps")))


@metric("pts_defect_pct", level="camera", family="vision", unit="%")
def pts_defect_pct(packets: DataFrame) -> DataFrame:
    """Repeated stamps, and steps over one and a half periods."""
    steps = _steps(packets)
    period = steps.where("step > 0").groupBy(*CAMERA).agg(F.median("step").alias("period"))
    out = steps.join(period, list(CAMERA), "left").groupBy(*CAMERA).agg(F.count("step").alias("n"), F.sum(((F.col("step") <= 0) | (F.col("step") > 1.5 * F.col("period"))).cast("int")).alias("bad"))
    return results(out, CAMERA, "pts_defect_pct", "%", 100.0 * F.coalesce("bad", F.lit(0)) / F.col("n"), first_reason((F.col("n") < 1, "too few packets")))


@metric("max_gap_s", level="camera", family="vision", unit="s")
def max_gap_s(packets: DataFrame) -> DataFrame:
    out = _steps(packets).groupBy(*CAMERA).agg(F.max("step").alias("value"))
    return results(out, CAMERA, "max_gap_s", "s", F.col("value"), first_reason((F.col("value").isNull(), "too few packets")))


@metric("camera_sync_skew_ms", level="episode", family="vision", unit="ms")
def camera_sync_skew_ms(packets: DataFrame) -> DataFrame:
    """How far apart cameras' usual delays are; packets: episode_id, camera, pts, recorded."""
    each = packets.groupBy(*CAMERA).agg(F.median(F.col("pts") - F.col("recorded")).alias("delay"))
    out = each.groupBy("episode_id").agg(F.count("delay").alias("n"), (1000 * (F.max("delay") - F.min("delay"))).alias("value"))
    return results(out, ("episode_id",), "camera_sync_skew_ms", "ms", F.col("value"), first_reason((F.col("n") < 2, "fewer than two cameras")))


@metric("camera_stream_present", level="camera", family="vision", unit="flag")
def camera_stream_present(headers: DataFrame) -> DataFrame:
    """headers: episode_id, camera, opens, first_decodes, frames_decode, width, height, fps, codec, pix_fmt."""
    ok = (F.coalesce("opens", F.lit(False)) & F.coalesce("first_decodes", F.lit(False))).cast("double")
    return results(headers, CAMERA, "camera_stream_present", "flag", ok, F.lit(None).cast("string"))


@metric("frames_readable", level="camera", family="vision", unit="flag")
def frames_readable(headers: DataFrame) -> DataFrame:
    return results(headers, CAMERA, "frames_readable", "flag", F.coalesce("frames_decode", F.lit(False)).cast("double"), first_reason((~F.coalesce("opens", F.lit(False)), "the file doesn't open")))


@metric("video_format_consistency", level="camera", family="vision", unit="fields")
def video_format_consistency(headers: DataFrame, declared: DataFrame) -> DataFrame:
    """Fields in which the header isn't what is declared; what isn't declared isn't compared."""
    d = declared.select(*CAMERA, *[F.col(c).alias(f"d_{c}") for c in ("width", "height", "fps", "pix_fmt")])
    exact = [(F.col(f"d_{c}").isNotNull() & (F.col(f"d_{c}") != F.col(c))).cast("int") for c in ("width", "height", "pix_fmt")]
    rate = (F.col("d_fps").isNotNull() & (F.abs(F.col("d_fps") - F.col("fps")) > 1e-3 * F.col("d_fps"))).cast("int")
    total = sum((F.coalesce(x, F.lit(0)) for x in [*exact, rate]), F.lit(0))
    return results(headers.join(d, list(CAMERA), "left"), CAMERA, "video_format_consistency", "fields", total, F.lit(None).cast("string"))


@metric("delivery_spec_met", level="camera", family="vision", unit="flag")
def delivery_spec_met(headers: DataFrame, *, width: int = 0, height: int = 0, fps: float = 0.0, codecs: tuple[str, ...] = ()) -> DataFrame:
    ok = (F.col("width") >= width) & (F.col("height") >= height) & (F.col("fps") >= fps * (1 - 1e-3))
    if codecs:
        ok = ok & F.col("codec").isin(*codecs)
    return results(headers, CAMERA, "delivery_spec_met", "flag", F.coalesce(ok, F.lit(False)).cast("double"), F.lit(None).cast("string"))


def frame_changes(stats: DataFrame) -> DataFrame:
    """Mean absolute change of thumbnails from the frame before, by the frame's contrast; null where either is blank."""
    w = Window.partitionBy(*CAMERA).orderBy("frame_idx")
    before = F.lag(F.when(~is_blank(), F.col("thumb"))).over(w)
    change = F.aggregate(F.zip_with("thumb", before, lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, d: s + d) / F.size("thumb")
    contrast = F.greatest(F.col("p95") - F.col("p5"), F.lit(1.0))
    return stats.select(*CAMERA, "frame_idx", "pts", F.when(~is_blank() & before.isNotNull(), 100 * change / contrast).alias("change"))


def moving_frames(controls: DataFrame) -> DataFrame:
    """Whether the control moves into each frame: its mean step over a twentieth of the 90th percentile; controls: episode_id, frame_idx, step."""
    top = controls.groupBy("episode_id").agg(F.percentile("step", F.lit(0.9)).alias("p90"))
    return controls.join(top, "episode_id").select("episode_id", "frame_idx", (F.col("step") > MOVING_SHARE * F.col("p90")).alias("moving"))


@metric("frozen_frame_pct", level="camera", family="vision", unit="%")
def frozen_frame_pct(changes: DataFrame, moving: DataFrame) -> DataFrame:
    """Frames in runs of half a second or more without change while the control moves through most of them."""
    floor = changes.groupBy(*CAMERA).agg(F.percentile("change", F.lit(0.1)).alias("p10"))
    w = Window.partitionBy(*CAMERA).orderBy("frame_idx")
    still = F.coalesce(F.col("change") < F.greatest(F.lit(FREEZE_FLOOR), 0.25 * F.col("p10")), F.lit(False))
    rows = changes.join(floor, list(CAMERA)).withColumn("still", still).withColumn("_new", (~F.col("still").eqNullSafe(F.lag("still").over(w))).cast("int")).withColumn("run", F.sum("_new").over(w))
    rows = rows.join(moving, ["episode_id", "frame_idx"], "left")
    found = rows.where("still").groupBy(*CAMERA, "run").agg(F.count("*").alias("n"), (F.max("pts") - F.min("pts")).alias("s"), F.avg(F.coalesce("moving", F.lit(False)).cast("double")).alias("share"))
    frozen = found.where((F.col("s") >= FREEZE_SECONDS) & (F.col("share") >= 0.5)).groupBy(*CAMERA).agg(F.sum("n").alias("frozen"))
    out = changes.groupBy(*CAMERA).agg(F.count("change").alias("n")).join(frozen, list(CAMERA), "left")
    return results(out, CAMERA, "frozen_frame_pct", "%", 100.0 * F.coalesce("frozen", F.lit(0)) / F.col("n"), first_reason((F.col("n") < 2, "too few frames")))


@metric("still_scene_pct", level="camera", family="vision", unit="%")
def still_scene_pct(changes: DataFrame) -> DataFrame:
    """Share of time in stretches of five seconds or more whose change, by its median within two seconds, stays small."""
    ns = (F.col("pts") * 1_000_000_000).cast("bigint")
    rows = changes.where("pts IS NOT NULL").withColumn("ns", ns)
    near = Window.partitionBy(*CAMERA).orderBy("ns").rangeBetween(-2_000_000_000, 2_000_000_000)
    w = Window.partitionBy(*CAMERA).orderBy("ns", "frame_idx")
    rows = rows.withColumn("smooth", F.when(F.count("change").over(near) >= 3, F.percentile("change", F.lit(0.5)).over(near)))
    still = F.coalesce(F.col("smooth") < STILL_SCENE, F.lit(False))
    rows = rows.withColumn("still", still).withColumn("_new", (~F.col("still").eqNullSafe(F.lag("still").over(w))).cast("int")).withColumn("run", F.sum("_new").over(w))
    runs = rows.where("still").groupBy(*CAMERA, "run").agg((F.max("pts") - F.min("pts")).alias("s")).where(F.col("s") >= STILL_SECONDS)
    whole = rows.groupBy(*CAMERA).agg((F.max("pts") - F.min("pts")).alias("span"), F.count("smooth").alias("n"))
    out = whole.join(runs.groupBy(*CAMERA).agg(F.sum("s").alias("still")), list(CAMERA), "left")
    return results(out, CAMERA, "still_scene_pct", "%", 100 * F.coalesce("still", F.lit(0.0)) / F.col("span"), first_reason((F.col("n") < 1, "too few frames"), (F.col("span") <= 0, "no time span")))


@metric("cut_count", level="camera", family="vision", unit="cuts")
def cut_count(changes: DataFrame, jumps: DataFrame) -> DataFrame:
    """Of the three greatest control jumps, those into whose frame the picture jumps too; jumps: episode_id, frame_idx, z."""
    top = Window.partitionBy("episode_id").orderBy(F.desc("z"), "frame_idx")
    wanted = jumps.groupBy("episode_id", "frame_idx").agg(F.max("z").alias("z")).withColumn("_n", F.row_number().over(top)).where("_n <= 3")
    ratio = local_step_ratio(changes)
    hits = ratio.join(wanted, ["episode_id", "frame_idx"]).where(F.col("ratio") > CUT_RATIO).groupBy(*CAMERA).agg(F.count("*").alias("cuts"))
    out = changes.groupBy(*CAMERA).agg(F.count("change").alias("n")).join(hits, list(CAMERA), "left")
    return results(out, CAMERA, "cut_count", "cuts", F.coalesce("cuts", F.lit(0)), first_reason((F.col("n") < 3, "too few frames")))


def local_step_ratio(changes: DataFrame, half: int = 6) -> DataFrame:
    """Each change over the median of its neighbours, not under the camera's lower quartile."""
    from .sequences import local_ratio

    rows = changes.select(F.col("episode_id"), F.col("camera").alias("stream"), F.lit("change").alias("channel"), F.col("frame_idx").alias("row_idx"), F.col("change").alias("v"))
    return local_ratio(rows, half).select("episode_id", F.col("stream").alias("camera"), F.col("row_idx").alias("frame_idx"), "ratio")


@metric("dropped_chunk_count", level="camera", family="vision", unit="chunks")
def dropped_chunk_count(changes: DataFrame, controls: DataFrame) -> DataFrame:
    """Whether the picture jumps beyond what the control does, ten steps from either end; controls: episode_id, camera, frame_idx, ratio."""
    w = Window.partitionBy(*CAMERA).orderBy("frame_idx")
    back = Window.partitionBy(*CAMERA).orderBy(F.desc("frame_idx"))
    rows = local_step_ratio(changes).join(controls.withColumnRenamed("ratio", "control"), [*CAMERA, "frame_idx"])
    rows = rows.withColumns({"_a": F.row_number().over(w), "_b": F.row_number().over(back)})
    inside = (F.col("_a") > EDGE_STEPS) & (F.col("_b") > EDGE_STEPS)
    out = rows.groupBy(*CAMERA).agg(F.count("*").alias("n"), F.max(F.when(inside, F.col("ratio") / F.greatest("control", F.lit(1e-9)))).alias("top"))
    return results(out, CAMERA, "dropped_chunk_count", "chunks", (F.col("top") > CHUNK_RATIO).cast("double"), first_reason((F.col("n") <= 2 * EDGE_STEPS, "too few steps")))


@metric("video_control_lag_ms", level="camera", family="vision", unit="ms")
def video_control_lag_ms(pairs: DataFrame, period_s: float) -> DataFrame:
    """The shift at which picture and control agree best; pairs: episode_id, camera, k, x (control), y (picture)."""
    from .alignment import best_lag, cross_correlation

    best = best_lag(cross_correlation(pairs, list(CAMERA)), list(CAMERA))
    out = pairs.select(*CAMERA).distinct().join(best, list(CAMERA), "left")
    return results(out, CAMERA, "video_control_lag_ms", "ms", F.col("refined") * period_s * 1000, first_reason((F.col("refined").isNull(), "too little overlap")))


def regrade_corrupt(stats: DataFrame, least: int = 2, times: float = 10.0) -> DataFrame:
    """Candidates that stand out from their camera: frames noisier than ten times its median, at least two of them."""
    usual = stats.groupBy("camera").agg(F.median("noise").alias("usual"))
    rows = stats.join(usual, "camera").where((F.col("noise") >= CORRUPT_NOISE) & (F.col("noise") >= times * F.col("usual")))
    return rows.groupBy(*CAMERA).agg(F.count("*").alias("candidates")).where(F.col("candidates") >= least)
