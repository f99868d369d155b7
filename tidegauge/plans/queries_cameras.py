"""Queries of cameras across episodes, pairs of a cohort, and control on video time.  Vectors stand for small pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import blocks as B
from ..operators import cameras as C
from ..operators import cohort as H
from . import datasets as D


def _pictures(spark, sf_dir):
    """Three cameras over the same episodes; the third is brighter, and for episodes 10 to 14 the second and third are exchanged; from episode 40 the first one's first places differ."""
    e = D.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("c"), F.floor(F.col("vec_id") / 3).alias("ord"), F.posexplode("embedding").alias("pos", "raw"))
    shown = F.when(F.col("ord").between(10, 14) & (F.col("c") > 0), 3 - F.col("c")).otherwise(F.col("c"))
    x = F.col("raw").cast("double") + 5 * F.col("c") * (F.col("pos") % 2) + F.when((F.col("c") == 0) & (F.col("ord") >= 40) & (F.col("pos") < 16), 8.0).otherwise(0.0)
    return e.select(F.concat(F.lit("cam"), shown).alias("camera"), F.concat(F.lit("e"), F.col("ord")).alias("episode"), "ord", "pos", F.round(x, 6).alias("x"))


def swap_scores(spark, sf_dir):
    return D.rounded(C.swap_scores(_pictures(spark, sf_dir)), 5)


def camera_swaps(spark, sf_dir):
    p = _pictures(spark, sf_dir)
    return D.rounded(C.swaps(p, p.select("episode", "ord").distinct()), 5)


def best_splits(spark, sf_dir):
    return C.best_splits(_pictures(spark, sf_dir))


def view_changes(spark, sf_dir):
    p = _pictures(spark, sf_dir)
    still = p.groupBy("camera", "episode").agg(F.avg((F.abs("x") < 8).cast("double")).alias("share"))
    return D.rounded(C.view_changes(p, still), 5)


def visual_variation(spark, sf_dir):
    return D.rounded(C.visual_variation(_pictures(spark, sf_dir)), 5)


def merged_moments(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 7).alias("part"), F.col("value").alias("x"))
    return D.rounded(C.merged_moments(C.partial_moments(e, ["event_type"], "part"), ["event_type"]), 3)


def lagged_change(spark, sf_dir):
    return D.rounded(C.lagged_change(_pictures(spark, sf_dir), 2), 5)


def histogram_percentiles(spark, sf_dir):
    counts = D.table(spark, sf_dir, "events").groupBy("event_type", F.least(F.floor("value"), F.lit(255)).cast("double").alias("value")).agg(F.count("*").alias("n"))
    return D.rounded(C.histogram_percentile(counts, ["event_type"], 0.95))


def worst_frames(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").withColumn("score", F.round("value", 0))
    return C.worst_frame(e, ["event_type", "user_id"], "score", "event_id")


def like_length_pairs(spark, sf_dir):
    """Users of one group whose numbers of events of each kind are alike."""
    e = D.table(spark, sf_dir, "events")
    rows = e.groupBy((F.col("user_id") % 10).alias("g"), "user_id", "event_type").agg(F.count("*").alias("n"))
    return D.rounded(B.like_pairs(rows, "g", "user_id", "event_type", "n", 0.34).select("a", "b", "mismatch"))


def budgeted_pairs(spark, sf_dir):
    return H.budgeted_pairs(D.table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 50)


def _steps(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("user_id", "event_id", (D.micros("ts") / 1e6).cast("double").alias("t"))
    frames = e.where("event_id % 3 = 0").select("user_id", "t")
    from pyspark.sql import Window

    c = e.where("event_id % 3 = 1").withColumn("a", F.lag("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    return c, frames


def frames_spanned(spark, sf_dir):
    c, frames = _steps(spark, sf_dir)
    steps = c.where("a IS NOT NULL").select("user_id", F.col("event_id").alias("_id"), "a", F.col("t").alias("b"))
    return A.frames_spanned(steps, frames, ["user_id"]).select("user_id", F.col("_id").alias("step"), F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))


def on_frame_steps(spark, sf_dir):
    from pyspark.sql import Window

    c, frames = _steps(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("t")
    control = c.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1).cast("bigint").alias("row_idx"), "t", (F.col("t") - F.col("a")).alias("step"))
    f = frames.select("user_id", "t", (F.row_number().over(w) - 1).cast("bigint").alias("frame"))
    return D.rounded(A.on_frame_steps(control, f, ["user_id"]), 3)


QUERIES = {f.__name__: f for f in (swap_scores, camera_swaps, best_splits, view_changes, visual_variation, merged_moments, lagged_change, histogram_percentiles, worst_frames, like_length_pairs, budgeted_pairs, frames_spanned, on_frame_steps)}

_P = """pic AS MATERIALIZED (SELECT 'cam' || CASE WHEN ord BETWEEN 10 AND 14 AND c > 0 THEN 3 - c ELSE c END AS camera, 'e' || ord AS episode, ord, pos - 1 AS pos,
  round(raw + 5 * c * ((pos - 1) % 2) + CASE WHEN c = 0 AND ord >= 40 AND pos <= 16 THEN 8.0 ELSE 0.0 END, 6) AS x
  FROM (SELECT vec_id % 3 AS c, vec_id // 3 AS ord, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS raw FROM embeddings))"""


def _score(name: str, table: str, xa: str, xb: str) -> str:
    return f"""u_{name} AS (SELECT a, b, pos, median({xa}) AS ma, median({xb}) AS mb FROM {table} GROUP BY ALL),
d_{name} AS (SELECT a, b, episode, ord, greatest(sqrt(avg(pow(xa - ma, 2))), 1e-9) AS aa, greatest(sqrt(avg(pow(xa - mb, 2))), 1e-9) AS ab, greatest(sqrt(avg(pow(xb - mb, 2))), 1e-9) AS bb, greatest(sqrt(avg(pow(xb - ma, 2))), 1e-9) AS ba FROM {table} JOIN u_{name} USING (a, b, pos) GROUP BY ALL),
{name} AS (SELECT a, b, episode, ord, greatest(ab / aa, ba / bb) AS score FROM d_{name})"""


_SWAP = f"""{_P}, pair AS MATERIALIZED (SELECT p.episode, p.ord, p.pos, p.camera AS a, q.camera AS b, p.x AS xa, q.x AS xb FROM pic p JOIN pic q ON p.episode = q.episode AND p.pos = q.pos AND p.camera < q.camera),
{_score("one", "pair", "xa", "xb")},
back AS (SELECT pair.*, CASE WHEN score < 1 THEN xb ELSE xa END AS ua, CASE WHEN score < 1 THEN xa ELSE xb END AS ub FROM pair JOIN one USING (a, b, episode, ord)),
{_score("two", "back", "ua", "ub")}"""
_SPLIT = f"""{_P}, r AS (SELECT camera, pos, row_number() OVER w AS k, count(*) OVER p AS n, sum(x) OVER w AS s, sum(x * x) OVER w AS q, sum(x) OVER p AS ss, sum(x * x) OVER p AS qq FROM pic WINDOW w AS (PARTITION BY camera, pos ORDER BY ord), p AS (PARTITION BY camera, pos)),
cost AS (SELECT camera, k, n, sum((q - s * s / k) + (qq - q - (ss - s) * (ss - s) / (n - k))) AS cost FROM r WHERE k >= 5 AND n - k >= 5 GROUP BY ALL),
split AS (SELECT camera, k AS split, n FROM cost QUALIFY row_number() OVER (PARTITION BY camera ORDER BY round(cost, 9), k) = 1)"""
_STEP = """ev AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events), fr AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS frame FROM ev WHERE event_id % 3 = 0),
c AS (SELECT user_id, event_id, t, lag(t) OVER w AS a, row_number() OVER w - 1 AS row_idx FROM ev WHERE event_id % 3 = 1 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""

SQL = {
    "swap_scores": f"WITH {_SWAP} SELECT a, b, episode, ord, round(score, 5) AS score FROM two",
    "camera_swaps": f"""WITH {_SWAP}, usual AS (SELECT a, b, median(score) AS median FROM two GROUP BY ALL HAVING count(*) >= 5 AND median(score) >= 2),
f AS (SELECT a, b, episode, ord, score, median, ord - row_number() OVER (PARTITION BY a, b ORDER BY ord) AS run FROM two JOIN usual USING (a, b) WHERE score <= 0.8)
SELECT a, b, round(median, 5) AS median, min_by(episode, ord) AS first, max_by(episode, ord) AS last, count(*) AS length, round(max(score), 5) AS worst FROM f GROUP BY a, b, run, median HAVING count(*) >= 3""",
    "best_splits": f"WITH {_SPLIT} SELECT camera, split::INT AS split, n FROM split",
    "view_changes": f"""WITH {_SPLIT}, s AS (SELECT pic.*, dense_rank() OVER (PARTITION BY camera ORDER BY ord) AS k, split FROM pic JOIN split USING (camera)), t AS (SELECT *, k > split AS side FROM s),
u AS (SELECT camera, side, pos, median(x) AS m FROM t GROUP BY ALL), gap AS (SELECT a.camera, sqrt(avg(pow(a.m - b.m, 2))) AS gap FROM u a JOIN u b ON a.camera = b.camera AND a.pos = b.pos AND NOT a.side AND b.side GROUP BY 1),
far AS (SELECT camera, split, k, sqrt(avg(pow(x - m, 2))) AS d FROM t JOIN u USING (camera, side, pos) GROUP BY ALL), w AS (SELECT camera, split, median(d) AS within FROM far GROUP BY ALL),
calm AS (SELECT camera FROM (SELECT camera, episode, avg(CASE WHEN abs(x) < 8 THEN 1.0 ELSE 0.0 END) AS share FROM pic GROUP BY ALL) GROUP BY 1 HAVING median(share) >= 0.4)
SELECT camera, split::INT AS split, round(gap / greatest(within, 1e-3), 5) AS score FROM w JOIN gap USING (camera) JOIN calm USING (camera) WHERE gap / greatest(within, 1e-3) >= 1.5""",
    "visual_variation": f"WITH {_P} SELECT camera, round(sqrt(2 * avg(v)), 5) AS variation FROM (SELECT camera, pos, var_samp(x) AS v FROM pic GROUP BY ALL) GROUP BY 1",
    "merged_moments": "SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean, round(var_pop(value) * count(*), 3) AS m2 FROM events GROUP BY 1",
    "lagged_change": f"WITH {_P}, r AS (SELECT *, x - lag(x, 2) OVER (PARTITION BY camera, pos ORDER BY ord) AS d FROM pic), m AS (SELECT camera, ord, median(d) AS m FROM r WHERE d IS NOT NULL GROUP BY ALL) SELECT camera, ord, round(quantile_cont(abs(d - m), 0.98), 5) AS change FROM r JOIN m USING (camera, ord) WHERE d IS NOT NULL GROUP BY ALL",
    "histogram_percentiles": "SELECT event_type, round(quantile_cont(least(floor(value), 255), 0.95), 6) AS percentile FROM events GROUP BY 1",
    "worst_frames": "SELECT event_type, user_id, event_id, round(value, 0) AS score FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY round(value, 0), event_id) = 1",
    "like_length_pairs": """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT p.user_id AS a, q.user_id AS b, round(max(abs(p.n - q.n) / greatest(p.n, q.n)::DOUBLE), 6) AS mismatch
FROM n p JOIN n q ON p.event_type = q.event_type AND p.user_id < q.user_id AND p.user_id % 10 = q.user_id % 10 GROUP BY ALL HAVING max(abs(p.n - q.n) / greatest(p.n, q.n)::DOUBLE) <= 0.34""",
    "budgeted_pairs": "SELECT p.p_brand, row_number() OVER (PARTITION BY p.p_brand ORDER BY p.p_partkey, q.p_partkey) - 1 AS rank, p.p_partkey AS a, q.p_partkey AS b FROM part p JOIN part q ON p.p_brand = q.p_brand AND p.p_partkey < q.p_partkey QUALIFY rank < 50",
    "frames_spanned": f"""WITH {_STEP}, g AS (SELECT user_id, count(*) AS frames, coalesce(median(gap), 0) * 1e-3 AS near FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM fr) GROUP BY 1),
s AS (SELECT c.user_id, c.event_id, frames, (SELECT count(*) FROM fr WHERE fr.user_id = c.user_id AND fr.t <= c.a + near) AS f, (SELECT count(*) FROM fr WHERE fr.user_id = c.user_id AND fr.t < c.t - near) AS l FROM c JOIN g USING (user_id) WHERE a IS NOT NULL)
SELECT user_id, event_id AS step, CASE WHEN greatest(l, f) < 1 OR f > frames - 1 THEN NULL ELSE least(greatest(f, 1), frames - 1) END AS first, CASE WHEN greatest(l, f) < 1 OR f > frames - 1 THEN NULL ELSE least(greatest(l, f, 1), frames - 1) END AS last FROM s""",
    "on_frame_steps": f"""WITH {_STEP}, near AS (SELECT fr.user_id, fr.frame, arg_min(c.row_idx, (abs(c.t - fr.t), c.t)) AS row_idx FROM fr JOIN c USING (user_id) WHERE frame > 0 GROUP BY ALL)
SELECT near.user_id, near.frame - 1 AS video_step, round(c.t - c.a, 3) AS step FROM near LEFT JOIN c ON c.user_id = near.user_id AND c.row_idx = greatest(near.row_idx, 1)""",
}
