"""Across episodes: copies, near copies, outliers, variation, cameras and containers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

POINTS = 32


def resampled(samples: DataFrame, keys: tuple[str, ...] = ("episode_id", "stream", "channel"), points: int = POINTS) -> DataFrame:
    """Each series at so many places evenly over it, linear between rows: keys, n, k, x.

    Only the two rows about a place are brought together with it: a join on row
    numbers, and no list of a series.
    """
    rows = samples.where("v IS NOT NULL").select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("row_idx")) - 1).cast("bigint").alias("i"), "v")
    size = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    grid = size.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).withColumn("at", F.col("k") * (F.col("n") - 1) / F.lit(points - 1))
    grid = grid.withColumns({"i": F.floor("at"), "j": F.least(F.floor("at") + 1, F.col("n") - 1)})
    low = grid.join(rows.withColumnRenamed("v", "a"), [*keys, "i"])
    both = low.join(rows.select(*keys, F.col("i").alias("j"), F.col("v").alias("b")), [*keys, "j"])
    return both.select(*keys, "n", "k", (F.col("a") + (F.col("at") - F.col("i")) * (F.col("b") - F.col("a"))).alias("x"))


def payload_keys(samples: DataFrame, keys: tuple[str, ...] = ("episode_id", "stream", "channel")) -> DataFrame:
    """A key of each series' exact content: rows, and order-bound sums of row hashes; equal series have equal keys."""
    one = F.xxhash64("row_idx", F.coalesce(F.col("v"), F.lit(float("nan"))))
    two = F.xxhash64(F.lit(7), "row_idx", F.coalesce(F.col("v"), F.lit(float("nan"))))
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(one).alias("h1"), F.bit_xor(two).alias("h2"))


def exact_copies(content: DataFrame, id_col: str, key: str) -> DataFrame:
    """Groups of equal content: key, the first id, and how many."""
    return content.groupBy(key).agg(F.min(id_col).alias("first"), F.count("*").alias("copies")).where("copies > 1")


def near_copies(vectors: DataFrame, *, limit: float = 0.02, id_col: str = "vec_id", group: str = "label", axes: int = 3, most: int | None = None) -> DataFrame:
    """All pairs within a group whose root mean square distance over the group's deviation is within a limit.

    vectors: id, group, x (array of doubles).  A projection never lengthens a
    distance: rows are dealt in blocks by their places on the ``axes`` of
    greatest spread, and two blocks meet where their boxes are within the
    limit; a task holds the two of a meeting and takes exact distances.
    With ``most``, pairs that are no id's nearest so many of a meeting are left out.
    """
    dim = F.size("x")
    each = vectors.select(group, F.posexplode("x").alias("p", "c"))
    spread = each.groupBy(group, "p").agg(F.var_pop("c").alias("var"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("var"), "p"))
    ranked = spread.withColumn("_r", place).groupBy(group).agg(F.sqrt(F.avg("var")).alias("scale"), F.array_sort(F.array_agg(F.when(F.col("_r") <= axes, F.col("p")))).alias("axes"))
    rows = vectors.join(F.broadcast(ranked), group).where("scale > 0").withColumn("r", F.col("scale") * limit * F.sqrt(dim.cast("double")))
    at = [F.nanvl(F.coalesce(F.get("x", F.get("axes", F.lit(k))), F.lit(0.0)), F.lit(0.0)) for k in range(axes)]
    rows = rows.withColumns({f"_c{k}": c for k, c in enumerate(at)})
    cuts = [F.percentile_approx(f"_c{k}", [i / 32 for i in range(1, 32)], 1000).alias(f"_q{k}") for k in range(axes)]
    size = rows.groupBy(group).agg(F.count("*").alias("_n"), *cuts)
    parts = F.least(F.ceil(F.pow(F.col("_n") / blocks.ROWS, F.lit(1 / axes))), F.lit(32))
    below = [F.size(F.filter(f"_q{k}", F.col(f"_c{k}").__gt__)) for k in range(axes)]
    strip = [F.floor(b * parts / 32) for b in below]
    rows = rows.join(F.broadcast(size), group).withColumn("_cell", sum((s * 32**k for k, s in enumerate(strip)), F.lit(0))).drop("_n")
    rows = blocks.dealt(rows, [group, "_cell"], id_col).withColumn("_block", F.col("_block") * 32**axes + F.col("_cell"))
    box = rows.groupBy(group, "_block").agg(F.max("r").alias("r"), *[f(f"_c{k}").alias(f"_{n}{k}") for k in range(axes) for n, f in (("lo", F.min), ("hi", F.max))])
    p, q = box.alias("p"), box.alias("q")
    gap = [F.greatest(F.col(f"p._lo{k}") - F.col(f"q._hi{k}"), F.col(f"q._lo{k}") - F.col(f"p._hi{k}"), F.lit(0.0)) for k in range(axes)]
    meetings = p.join(q, F.col(f"p.{group}") == F.col(f"q.{group}")).where(F.col("p._block") <= F.col("q._block")).where(sum((g * g for g in gap), F.lit(0.0)) <= F.pow(F.greatest("p.r", "q.r"), F.lit(2)) * (1 + 1e-9))
    meetings = meetings.select(F.col(f"p.{group}").alias(group), F.col("p._block").alias("_p"), F.col("q._block").alias("_q"))
    return blocks.near_pairs(rows.select(group, id_col, "scale", "x", "_block"), meetings, group, id_col, limit, most)


def of_like_length(pairs: DataFrame, rows: DataFrame, id_col: str, key: str, n: str, most: float = 0.1) -> DataFrame:
    """Pairs whose numbers of rows differ by a tenth of the longer at most, on every stream that both have."""
    count = lambda side: rows.select(F.col(id_col).alias(side), key, F.col(n).alias(f"n_{side}"))
    far = F.max(F.abs(F.col("n_a") - F.col("n_b")) / F.greatest("n_a", "n_b"))
    return pairs.join(count("a"), "a").join(count("b"), ["b", key]).groupBy(*pairs.columns).agg(far.alias("mismatch")).where(F.col("mismatch") <= most)


def listed_pairs(pairs: DataFrame, most: int = 1_500_000, partners: int = 5) -> DataFrame:
    """All pairs where they are few enough to list, else each id's nearest partners only."""
    if pairs.count() <= most:
        return pairs.select("a", "b", "nrmse")
    near = nearest_partners(pairs, partners)
    return near.select(F.least("id", "partner").alias("a"), F.greatest("id", "partner").alias("b"), "nrmse").distinct()


def budgeted_pairs(items: DataFrame, keys: list[str], id_col: str, budget: int) -> DataFrame:
    """The first ``budget`` pairs of each cohort in the order (first, second): pairs are made from their numbers, none beyond the budget."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(id_col)) - 1
    rows = items.select(*keys, id_col).distinct().withColumn("i", place.cast("bigint"))
    size = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(budget).cast("bigint"), F.col("n") * (F.col("n") - 1) / 2).cast("bigint") - 1)).alias("r")
    m = 2 * F.col("n") - 1
    first = F.floor((m - F.sqrt((m * m - 8 * F.col("r")).cast("double"))) / 2)
    before = F.col("i") * (m - F.col("i")) / 2
    pairs = size.where("n > 1").select(*keys, "n", number).withColumn("i", first).withColumn("j", (F.col("r") - before + F.col("i") + 1).cast("bigint"))
    name = lambda i, c: rows.select(*keys, F.col("i").alias(i), F.col(id_col).alias(c))
    return pairs.join(name("i", "a"), [*keys, "i"]).join(name("j", "b"), [*keys, "j"]).select(*keys, F.col("r").alias("rank"), "a", "b")


def nearest_partners(pairs: DataFrame, most: int = 5) -> DataFrame:
    """The nearest partners of each id among listed pairs, ties by id."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("partner"), "nrmse").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("partner"), "nrmse"))
    w = Window.partitionBy("id").orderBy("nrmse", "partner")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def saturated(n_pairs: int, n_near: int, episodes: int) -> bool:
    """Whether near copies are so many that they say nothing."""
    return n_near > 0.5 * n_pairs and n_near > episodes


def rms_pairwise(vectors: DataFrame, group: str = "label") -> DataFrame:
    """The root mean square distance over all pairs, in closed form from each position's variance."""
    each = vectors.select(group, F.posexplode("x").alias("p", "c"))
    return each.groupBy(group, "p").agg(F.var_samp("c").alias("var")).groupBy(group).agg(F.sqrt(2 * F.avg("var")).alias("variation"))


def pooled(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of the whole from (n, mean, var) of its parts."""
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"))
    rows = parts.join(whole, keys)
    return rows.groupBy(*keys, "total", "m").agg(F.sqrt(F.sum(F.col("n") * (F.col("var") + (F.col("mean") - F.col("m")) ** 2)) / F.first("total")).alias("std")).withColumnsRenamed({"m": "mean", "total": "n"})


def fences(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles and Tukey's fences."""
    q = values.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    q1, q2, q3 = (F.get("q", F.lit(k)) for k in range(3))
    return q.select(*keys, "n", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), (q1 - 1.5 * (q3 - q1)).alias("low"), (q3 + 1.5 * (q3 - q1)).alias("high"))


def outside_fences(values: DataFrame, keys: list[str], value: str, least: int = 5) -> DataFrame:
    bounds = fences(values, keys, value).where(F.col("n") >= least)
    return values.join(F.broadcast(bounds), keys).where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).select(*values.columns)


def median_without_self(values: DataFrame, keys: list[str], id_col: str, value: str) -> DataFrame:
    """For each row the median of the others of its group, by its place in the order: no list is made."""
    w = Window.partitionBy(*keys).orderBy(value, id_col)
    rows = values.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys))})
    # of n - 1 others the middle ones are at these places of the others, one further in the whole order if at or past the row's own
    m = F.col("_n") - 1
    low, high = F.floor((m + 1) / 2), F.floor((m + 2) / 2)
    at = lambda p: (p + F.when(p >= F.col("_r"), 1).otherwise(0)).cast("int")
    rows = rows.withColumns({"_a": at(low), "_b": at(high)})
    place = rows.select(*keys, F.col("_r").alias("_p"), F.col(value).alias("_v"))
    mine = rows.where("_n > 1")
    a = mine.join(place.withColumnsRenamed({"_p": "_a", "_v": "_x"}), [*keys, "_a"])
    b = a.join(place.withColumnsRenamed({"_p": "_b", "_v": "_y"}), [*keys, "_b"])
    return b.select(*keys, id_col, value, ((F.col("_x") + F.col("_y")) / 2).alias("others"))


def container_hints(files: DataFrame, keys: list[str], id_col: str, rate: str, least: int = 5) -> DataFrame:
    """Files whose rate is under a quarter or over three times the median of the others, in groups of so many at least."""
    rows = median_without_self(files, keys, id_col, rate)
    size = files.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ratio = F.col(rate) / F.col("others")
    return rows.join(size, keys).where((ratio < 0.25) | (ratio > 3)).select(*keys, id_col, F.when(ratio < 0.25, "low").otherwise("high").alias("hint"))


def histogram(values: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """Counts over [0, 1] in equal bins, the last one closed; bin -1 holds what is outside."""
    x = F.col(value)
    bin_ = F.when((x < 0) | (x > 1), -1).otherwise(F.least(F.floor(x * bins), F.lit(bins - 1)))
    return values.groupBy(*keys, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon's entropy in nats of the bins within."""
    inside = counts.where("bin >= 0")
    total = inside.groupBy(*keys).agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return inside.join(total, keys).groupBy(*keys).agg((-F.sum(p * F.log(p))).alias("entropy"))


def effective_dimensions(vectors: DataFrame, group: str = "label") -> DataFrame:
    """trace(C)**2 / |C|**2 of the covariance: the eigenvalues' own measure without finding them."""
    place = F.sequence(F.lit(0), F.size("x") - 1)
    pairs = F.flatten(F.transform(place, lambda i: F.transform(F.sequence(F.lit(0), i), lambda j: F.struct(i.alias("i"), j.alias("j"), F.get("x", i).alias("a"), F.get("x", j).alias("b")))))
    p = vectors.select(group, F.explode_outer(F.when(F.size("x") > 0, pairs)).alias("p")).select(group, "p.*")
    c = p.groupBy(group, "i", "j").agg(F.covar_samp("a", "b").alias("c"))
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("c")))
    norm = F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(2) * F.col("c") * F.col("c"))
    return c.groupBy(group).agg((trace * trace / norm).alias("dimensions"))


def cohort_outliers(values: DataFrame, keys: list[str], id_col: str, least: int = 5) -> DataFrame:
    """Distance of each item from its cohort: root mean square of robust z over features with a positive MAD.

    values: keys, id, feature, x.
    """
    by = [*keys, "feature"]
    middle = values.groupBy(*by).agg(F.median("x").alias("m"), F.count("*").alias("n"))
    rows = values.join(middle, by).withColumn("d", F.abs(F.col("x") - F.col("m")))
    mad = rows.groupBy(*by).agg(F.median("d").alias("mad"))
    rows = rows.join(mad, by).where((F.col("mad") > 0) & (F.col("n") >= least))
    z = (F.col("x") - F.col("m")) / (1.4826 * F.col("mad"))
    return rows.groupBy(*keys, id_col).agg(F.sqrt(F.avg(z * z)).alias("distance"))


def phase_balance(points: DataFrame, phases: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Finite rows in each labelled phase."""
    from .alignment import in_intervals

    return in_intervals(points, phases, keys, width).groupBy("phase").agg(F.count("*").alias("n"))


def _bootstrap(group: pd.DataFrame, draws: int, seed: int) -> pd.DataFrame:
    x = np.sort(group["mean"].to_numpy(float))
    rng = np.random.default_rng(seed)
    means = x[rng.integers(0, len(x), (draws, len(x)))].mean(1)
    return pd.DataFrame([{"group": str(group["group"].iloc[0]), "mean": x.mean(), "low": float(np.percentile(means, 2.5)), "high": float(np.percentile(means, 97.5))}])


def session_bootstrap(values: DataFrame, draws: int = 200, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean over sessions; values: group, session, x.

    Sessions are reduced to their means first: a task holds a number for each session of a group.
    """
    from functools import partial

    means = values.groupBy(F.col("group").cast("string").alias("group"), "session").agg(F.avg("x").alias("mean"))
    return means.groupBy("group").applyInPandas(partial(_bootstrap, draws=draws, seed=seed), "group string, mean double, low double, high double")


def camera_pairs(frames: DataFrame) -> DataFrame:
    """Each unordered pair of cameras over their shared episodes."""
    c = frames.select("episode_id", "camera").distinct()
    return c.alias("x").join(c.alias("y"), (F.col("x.episode_id") == F.col("y.episode_id")) & (F.col("x.camera") < F.col("y.camera"))).groupBy(F.col("x.camera").alias("a"), F.col("y.camera").alias("b")).agg(F.count("*").alias("episodes"))


def shared_footage(content: DataFrame) -> DataFrame:
    """Content under two cameras or more: hash, cameras, episodes."""
    return content.groupBy("hash").agg(F.count_distinct("camera").alias("cameras"), F.count_distinct("episode_id").alias("episodes")).where("cameras > 1")


def binomial_upper(successes: int, trials: int, confidence: float = 0.95) -> float:
    """The exact one-sided upper bound of a rate (Clopper-Pearson), by bisection."""
    if successes >= trials:
        return 1.0

    def below(p: float) -> float:
        logs = (math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * math.log(p) + (trials - k) * math.log1p(-p) for k in range(successes + 1))
        return math.fsum(math.exp(x) for x in logs)

    low, high = 0.0, 1.0
    for _ in range(70):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) > 1 - confidence else (low, mid)
    return high
