"""Cameras across episodes: swaps, changes of view, variation.

pictures: camera, episode, ord (the episodes' order), pos, x; one row for each
place of a small picture, so that medians over episodes are grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_EPISODES = 5
SWAP_SCORE, SWAP_SEPARATION, SWAP_RUN = 0.8, 2.0, 3
VIEW_SCORE, STILL_SHARE, VIEW_FLOOR = 1.5, 0.4, 1e-3


def paired(pictures: DataFrame) -> DataFrame:
    """Each two cameras' pictures of the same episode, place by place; cameras are few, so an episode has few pairs."""
    a = pictures.select("episode", "ord", "pos", F.col("camera").alias("a"), F.col("x").alias("xa"))
    b = pictures.select("episode", "pos", F.col("camera").alias("b"), F.col("x").alias("xb"))
    return a.join(b, ["episode", "pos"]).where("a < b")


def _scored(pairs: DataFrame, xa: str, xb: str) -> DataFrame:
    """Per pair and episode: the larger ratio of the distance to the other's usual picture and to its own."""
    usual = pairs.groupBy("a", "b", "pos").agg(F.median(xa).alias("ma"), F.median(xb).alias("mb"))
    rows = pairs.join(usual, ["a", "b", "pos"])
    far = lambda x, m: F.greatest(F.sqrt(F.avg((F.col(x) - F.col(m)) ** 2)), F.lit(1e-9))
    d = rows.groupBy("a", "b", "episode", "ord").agg(far("xa", "ma").alias("aa"), far("xa", "mb").alias("ab"), far("xb", "mb").alias("bb"), far("xb", "ma").alias("ba"))
    return d.select("a", "b", "episode", "ord", F.greatest(F.col("ab") / F.col("aa"), F.col("ba") / F.col("bb")).alias("score"))


def swap_scores(pictures: DataFrame) -> DataFrame:
    """(a, b, episode, ord, score); 1 or less looks more like the other camera.

    Usual pictures are medians taken twice, the second time with the pictures of
    episodes that the first pass finds swapped exchanged back.
    """
    pairs = paired(pictures)
    first = _scored(pairs, "xa", "xb").select("a", "b", "episode", (F.col("score") < 1).alias("swapped"))
    back = pairs.join(first, ["a", "b", "episode"]).withColumns({"ua": F.when(F.col("swapped"), F.col("xb")).otherwise(F.col("xa")), "ub": F.when(F.col("swapped"), F.col("xa")).otherwise(F.col("xb"))})
    return _scored(back, "ua", "ub")


def swaps(pictures: DataFrame, episodes: DataFrame) -> DataFrame:
    """Runs of episodes in which two cameras hold each other's footage: a, b, first, last, length, and the pair's median score.

    episodes: episode and its place ``ord`` in the report, without gaps.  An
    episode that lacks one of the two ends a run.
    """
    scores = swap_scores(pictures)
    usual = scores.groupBy("a", "b").agg(F.median("score").alias("median"), F.count("*").alias("n")).where((F.col("n") >= LEAST_EPISODES) & (F.col("median") >= SWAP_SEPARATION))
    flagged = scores.where(F.col("score") <= SWAP_SCORE).join(usual, ["a", "b"]).join(episodes.select("episode", F.col("ord").alias("at")), "episode")
    run = F.col("at") - F.row_number().over(Window.partitionBy("a", "b").orderBy("at"))
    found = flagged.withColumn("run", run).groupBy("a", "b", "run", "median").agg(F.min_by("episode", "at").alias("first"), F.max_by("episode", "at").alias("last"), F.count("*").alias("length"), F.max("score").alias("worst"))
    return found.where(F.col("length") >= SWAP_RUN).drop("run")


def best_splits(pictures: DataFrame, least: int = LEAST_EPISODES) -> DataFrame:
    """(camera, split, n): the number of first episodes that leaves the least squares within both groups, over all places at once."""
    place = Window.partitionBy("camera", "pos").orderBy("ord")
    past, whole = place.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("camera", "pos")
    x = F.col("x")
    rows = pictures.select("camera", "pos", F.row_number().over(place).alias("k"), F.count("*").over(whole).alias("n"), F.sum(x).over(past).alias("s"), F.sum(x * x).over(past).alias("q"), F.sum(x).over(whole).alias("ss"), F.sum(x * x).over(whole).alias("qq"))
    k, n, s, q, ss, qq = (F.col(c) for c in ("k", "n", "s", "q", "ss", "qq"))
    cost = (q - s * s / k) + (qq - q - (ss - s) * (ss - s) / (n - k))
    sums = rows.where((k >= least) & (n - k >= least)).groupBy("camera", "k", "n").agg(F.sum(cost).alias("cost"))
    order = Window.partitionBy("camera").orderBy(F.round("cost", 9), "k")
    return sums.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("camera", F.col("k").alias("split"), "n")


def split_scores(pictures: DataFrame, splits: DataFrame) -> DataFrame:
    """(camera, split, score): the distance of the two groups' medians over the median distance of a picture to its own group's."""
    place = F.dense_rank().over(Window.partitionBy("camera").orderBy("ord"))
    rows = pictures.withColumn("k", place).join(F.broadcast(splits.select("camera", "split")), "camera").withColumn("side", (F.col("k") > F.col("split")).cast("int"))
    usual = rows.groupBy("camera", "side", "pos").agg(F.median("x").alias("m"))
    both = usual.groupBy("camera", "pos").agg(F.max(F.when(F.col("side") == 0, F.col("m"))).alias("m0"), F.max(F.when(F.col("side") == 1, F.col("m"))).alias("m1"))
    gap = both.groupBy("camera").agg(F.sqrt(F.avg((F.col("m0") - F.col("m1")) ** 2)).alias("gap"))
    far = rows.join(usual, ["camera", "side", "pos"]).groupBy("camera", "split", "k").agg(F.sqrt(F.avg((F.col("x") - F.col("m")) ** 2)).alias("d"))
    within = far.groupBy("camera", "split").agg(F.median("d").alias("within"))
    return within.join(gap, "camera").select("camera", "split", (F.col("gap") / F.greatest("within", F.lit(VIEW_FLOOR))).alias("score"))


def view_changes(pictures: DataFrame, still: DataFrame) -> DataFrame:
    """Cameras whose view changes for good: camera, split, score.  still: camera, episode, share of still places."""
    calm = still.groupBy("camera").agg(F.median("share").alias("share")).where(F.col("share") >= STILL_SHARE)
    return split_scores(pictures, best_splits(pictures)).join(calm.select("camera"), "camera", "left_semi").where(F.col("score") >= VIEW_SCORE)


def visual_variation(pictures: DataFrame) -> DataFrame:
    """Per camera the root mean square distance of two of its episodes' pictures, from moments: no pair is made."""
    each = pictures.groupBy("camera", "pos").agg(F.var_samp("x").alias("v"))
    return each.groupBy("camera").agg(F.sqrt(2 * F.avg("v")).alias("variation"))


def partial_moments(values: DataFrame, keys: list[str], part: str, x: str = "x") -> DataFrame:
    """n, mean and m2 (squares about the mean) of each part."""
    return values.groupBy(*keys, part).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The moments of the whole from those of its parts, in any order and number."""
    n = F.sum("n")
    out = parts.groupBy(*keys).agg(n.alias("n"), (F.sum(F.col("n") * F.col("mean")) / n).alias("mean"), F.sum("m2").alias("within"), F.sum(F.col("n") * F.col("mean") ** 2).alias("sq"))
    return out.select(*keys, "n", "mean", (F.col("within") + F.col("sq") - F.col("n") * F.col("mean") ** 2).alias("m2"))


def lagged_change(pictures: DataFrame, lag: int, share: float = 0.98) -> DataFrame:
    """Per camera and picture: how far places change against the picture ``lag`` before, brightness set aside: the 98th percentile of |change - its median|."""
    w = Window.partitionBy("camera", "pos").orderBy("ord")
    rows = pictures.withColumn("d", F.col("x") - F.lag("x", lag).over(w)).where("d IS NOT NULL")
    shift = rows.groupBy("camera", "ord").agg(F.median("d").alias("m"))
    return rows.join(shift, ["camera", "ord"]).groupBy("camera", "ord").agg(F.percentile(F.abs(F.col("d") - F.col("m")), share).alias("change"))


def histogram_percentile(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The linear percentile of values given as counts: keys, value, n."""
    w = Window.partitionBy(*keys).orderBy("value")
    rows = counts.where("n > 0").withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(*keys))})
    at = (F.col("total") - 1) * F.lit(share)
    low, high = F.floor(at), F.ceil(at)
    found = rows.groupBy(*keys).agg(F.min(F.when(F.col("upto") > low, F.col("value"))).alias("a"), F.min(F.when(F.col("upto") > high, F.col("value"))).alias("b"), F.first(at - low).alias("part"))
    return found.select(*keys, (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("percentile"))


def worst_frame(frames: DataFrame, keys: list[str], value: str, order: str, least: bool = True) -> DataFrame:
    """The frame of the least (or greatest) value, the first of equals."""
    v = F.col(value).asc() if least else F.col(value).desc()
    return frames.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(v, order))).where("_r = 1").select(*keys, order, value)
