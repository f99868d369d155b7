"""Queries of joins in time and of sequences."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators import sequences as Q
from ..operators import timing
from . import datasets as D

HOUR = 3_600_000_000


def _events(spark, sf_dir, kind):
    e = D.table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select("user_id", D.micros("ts").alias("t"), "event_id", F.col("value").alias("v"))


def _ev(kind: str) -> str:
    return f"(SELECT user_id, epoch_us(ts) AS t, event_id, value AS v FROM events WHERE event_type = '{kind}')"


def _known(df):
    """Unmatched rows with -1 for a time."""
    return df.withColumn("match_t", F.coalesce("match_t", F.lit(-1).cast("bigint")))


def asof_previous(spark, sf_dir):
    return _known(A.as_of(_events(spark, sf_dir, "click"), _events(spark, sf_dir, "purchase").drop("event_id"), ["user_id"], direction="previous"))


def asof_nearest(spark, sf_dir):
    return _known(A.as_of(_events(spark, sf_dir, "click"), _events(spark, sf_dir, "purchase").drop("event_id"), ["user_id"], tolerance=12 * HOUR))


def timing_report(spark, sf_dir):
    r = A.timing_report(_events(spark, sf_dir, "click"), _events(spark, sf_dir, "purchase").drop("event_id"), ["user_id"], 12 * HOUR)
    return D.rounded(r.withColumns({c: F.col(c) / 1e6 for c in ("skew_median", "skew_p95", "age_p95")}), 4)


def tracking_report(spark, sf_dir):
    command, state = (_events(spark, sf_dir, k).withColumn("t", F.col("t") * 1000).drop("event_id") for k in ("click", "view"))
    return D.rounded(A.tracking_report(command, state, ["user_id"], delay=HOUR * 1000, tolerance=24 * HOUR * 1000))


def event_fit(spark, sf_dir):
    """Order lines as declared pairs: quantity against price, by line number."""
    li = D.table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_extendedprice").alias("left_t"), F.col("l_quantity").alias("right_t"))
    return D.rounded(A.event_fit(li, ["l_linenumber"]), 4)


def training_windows(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("episode_id"), F.col("event_type").alias("modality"), D.micros("ts").alias("t"))
    episodes = e.groupBy("episode_id").agg(F.min("t").alias("start"), F.max("t").alias("stop"))
    w = A.training_windows(episodes, e.where("modality IN ('click', 'view')"), step=6 * HOUR, history=4, prediction=2, stride=3, max_age=48 * HOUR)
    return A.budgeted(w, 20)


def interval_join(spark, sf_dir):
    """Purchases within two hours after an error of the same user."""
    p = _events(spark, sf_dir, "purchase").select("user_id", F.col("t").alias("at"), "event_id")
    e = _events(spark, sf_dir, "error").select("user_id", F.col("t").alias("start"), (F.col("t") + 2 * HOUR).alias("stop"), F.col("event_id").alias("error_id"))
    return A.in_intervals(p, e, ["user_id"], 4 * HOUR).select("user_id", "event_id", "error_id")


def segments(spark, sf_dir):
    s = D.event_samples(spark, sf_dir)
    return D.rounded(A.segment_motion(s, ["episode_id", "stream"], 6 * 3600.0), 4)


def _daily(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("k"), "event_type", F.lit("all").alias("g"))
    return e.groupBy("g", "k").agg(F.sum((F.col("event_type") == "click").cast("double")).alias("x"), F.sum((F.col("event_type") == "purchase").cast("double")).alias("y"))


def cross_correlation(spark, sf_dir):
    return D.rounded(A.cross_correlation(_daily(spark, sf_dir), ["g"]))


def best_lag(spark, sf_dir):
    return D.rounded(A.best_lag(A.cross_correlation(_daily(spark, sf_dir), ["g"]), ["g"]), 5)


_XC = """daily AS (SELECT 'all' AS g, date_diff('day', DATE '2024-01-01', ts::DATE) AS k, count(*) FILTER (event_type = 'click')::DOUBLE AS x, count(*) FILTER (event_type = 'purchase')::DOUBLE AS y FROM events GROUP BY ALL),
xc AS (SELECT a.g, lag_ AS lag, count(*) AS n, corr(a.x, b.y) AS r FROM daily a, range(-10, 11) l(lag_) JOIN daily b ON b.k = a.k + lag_ GROUP BY ALL HAVING count(*) >= 10)"""


def _arm(f):
    def run(spark, sf_dir):
        return f(D.arm_samples(spark, sf_dir))

    return run


_KEYS = ("episode_id", "stream", "channel")


def longest_run(spark, sf_dir):
    return Q.longest_run(D.arm_parts(spark, sf_dir))


def flat_runs(spark, sf_dir):
    return Q.equal_runs(D.event_samples(spark, sf_dir))


def detrend(spark, sf_dir):
    return D.rounded(Q.detrended(D.event_samples(spark, sf_dir)).select(*_KEYS, "row_idx", "detrended"))


def neighbour_max(spark, sf_dir):
    return D.rounded(Q.neighbour_max(D.event_samples(spark, sf_dir)).select(*_KEYS, "row_idx", "near_max"))


def robust_z(spark, sf_dir):
    return D.rounded(Q.robust_z(D.event_samples(spark, sf_dir)).select(*_KEYS, "row_idx", "z"))


def local_ratio(spark, sf_dir):
    return D.rounded(Q.local_ratio(D.event_samples(spark, sf_dir)).select(*_KEYS, "row_idx", "ratio"))


def angle_unwrap(spark, sf_dir):
    """The time of day as an angle."""
    s = D.event_samples(spark, sf_dir)
    s = s.withColumn("v", F.pmod(F.col("native"), F.lit(24 * HOUR)) * (2 * math.pi / (24 * HOUR)))
    return D.rounded(Q.unwrapped(s).select(*_KEYS, "row_idx", "unwrapped"), 4)


def monotonic_fraction(spark, sf_dir):
    return D.rounded(Q.monotonic_fraction(D.event_samples(spark, sf_dir)))


def change_point(spark, sf_dir):
    daily = D.table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.round(F.avg("value"), 6).alias("x"))
    return D.rounded(Q.change_point(daily, ("event_type",), "day", "x"), 4)


def support_intervals(spark, sf_dir):
    """Rows over 200, with two rows on either side."""
    rows = D.event_samples(spark, sf_dir).where("v > 150")
    return Q.support_intervals(rows, ("episode_id", "stream"), margin=2)


def split_intervals(spark, sf_dir):
    rows = D.event_samples(spark, sf_dir).where("v > 150").select("episode_id", "stream", F.greatest(F.col("row_idx") - 2, F.lit(0)).alias("start"), (F.col("row_idx") + 3).alias("stop"))
    return Q.split_intervals(rows, ("episode_id", "stream"))


def number_runs(spark, sf_dir):
    """Runs of order numbers of each customer."""
    return Q.numbered_runs(D.table(spark, sf_dir, "orders"), ("o_custkey",), "o_orderkey")


def regularity(spark, sf_dir):
    return D.rounded(timing.regularity(D.event_samples(spark, sf_dir), D.event_streams(spark, sf_dir)))


def violation_rows(spark, sf_dir):
    """In an order that scatters the ids, event times go backwards."""
    e = D.table(spark, sf_dir, "events")
    s = e.select(F.lit("all").alias("episode_id"), F.col("event_type").alias("stream"), F.lit("value").alias("channel"), (F.col("event_id") * 7919 % 1000003).alias("row_idx"), D.micros("ts").alias("native"))
    streams = s.select("episode_id", "stream").distinct().withColumn("scale", F.lit(1e-6))
    return timing.violation_rows(s, streams)


_W = "(PARTITION BY episode_id, stream, channel ORDER BY row_idx)"
_FAR = f"SELECT episode_id, stream, greatest(row_idx - 2, 0) AS start, row_idx + 3 AS stop FROM samples WHERE v > 150"
_MERGE = """m AS (SELECT *, sum(new) OVER (PARTITION BY episode_id, stream ORDER BY start, stop) AS g FROM (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY episode_id, stream ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE
    THEN 1 ELSE 0 END AS new FROM far)), cover AS (SELECT episode_id, stream, min(start) AS start, max(stop) AS stop FROM m GROUP BY episode_id, stream, g)"""
_NEAREST = f"""c AS {_ev("click")}, p AS {_ev("purchase")},
back AS (SELECT c.*, p.t AS bt, p.v AS bv FROM c ASOF LEFT JOIN (SELECT user_id, t, max(v) AS v FROM p GROUP BY ALL) p ON c.user_id = p.user_id AND c.t >= p.t),
ahead AS (SELECT c.event_id, p.t AS ft, p.v AS fv FROM c ASOF LEFT JOIN (SELECT user_id, t, min(v) AS v FROM p GROUP BY ALL) p ON c.user_id = p.user_id AND c.t < p.t),
near AS (SELECT user_id, t, event_id, v, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN bt ELSE ft END AS mt, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN bv ELSE fv END AS mv FROM back JOIN ahead USING (event_id)),
matched AS (SELECT user_id, t, event_id, v, CASE WHEN abs(mt - t) <= {12 * HOUR} THEN mt END AS match_t, CASE WHEN abs(mt - t) <= {12 * HOUR} THEN mv END AS match_v FROM near)"""


def _probe(name: str, source: str) -> str:
    return f"""b{name} AS (SELECT c.*, s.t AS bt, s.v AS bv FROM {source} c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.t >= s.t),
f{name} AS (SELECT c.event_id, s.t AS ft, s.v AS fv FROM {source} c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.t < s.t),
{name} AS (SELECT user_id, event_id, t, v, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt <= ft - t) THEN CASE WHEN t - bt <= {24 * HOUR * 1000} THEN bv END ELSE CASE WHEN ft - t <= {24 * HOUR * 1000} THEN fv END END AS x FROM b{name} JOIN f{name} USING (event_id))"""


QUERIES = {
    f.__name__: f
    for f in (
        asof_previous,
        asof_nearest,
        timing_report,
        tracking_report,
        event_fit,
        training_windows,
        interval_join,
        segments,
        cross_correlation,
        best_lag,
        longest_run,
        flat_runs,
        detrend,
        neighbour_max,
        robust_z,
        local_ratio,
        angle_unwrap,
        monotonic_fraction,
        change_point,
        support_intervals,
        split_intervals,
        number_runs,
        regularity,
        violation_rows,
    )
}

SQL = {
    "asof_previous": f"""WITH c AS {_ev("click")}, p AS {_ev("purchase")}
SELECT c.user_id, c.t, c.event_id, c.v, coalesce(p.t, -1) AS match_t, p.v AS match_v FROM c ASOF LEFT JOIN (SELECT user_id, t, max(v) AS v FROM p GROUP BY ALL) p ON c.user_id = p.user_id AND c.t >= p.t""",
    "asof_nearest": f"WITH {_NEAREST} SELECT * REPLACE (coalesce(match_t, -1) AS match_t) FROM matched",
    "timing_report": f"""WITH {_NEAREST}, a AS (SELECT user_id, count(*) AS n, avg(CASE WHEN match_t IS NULL THEN 0.0 ELSE 1.0 END) AS matched, median(match_t - t) AS skew_median, quantile_cont(abs(match_t - t), 0.95) AS skew_p95 FROM matched GROUP BY 1),
b AS (SELECT user_id, quantile_cont(t - bt, 0.95) AS age_p95 FROM back GROUP BY 1)
SELECT user_id, n, round(matched, 4) AS matched, round(skew_median / 1e6, 4) + 0.0 AS skew_median, round(skew_p95 / 1e6, 4) AS skew_p95, round(age_p95 / 1e6, 4) AS age_p95 FROM a JOIN b USING (user_id)""",
    "tracking_report": f"""WITH c AS (SELECT * REPLACE (t * 1000 AS t) FROM {_ev("click")}), s AS (SELECT * REPLACE (t * 1000 AS t) FROM {_ev("view")}),
d AS (SELECT user_id, event_id, t + {HOUR * 1000} AS t, v FROM c), {_probe("nw", "c")}, {_probe("lt", "d")},
e AS (SELECT user_id, nw.v AS command, nw.x AS now, lt.x AS later FROM nw JOIN lt USING (user_id, event_id) WHERE nw.x IS NOT NULL AND lt.x IS NOT NULL)
SELECT user_id, count(*) AS n, round(sqrt(avg((now - command) ** 2)), 6) AS rmse_now, round(sqrt(avg((later - command) ** 2)), 6) AS rmse_later, round(quantile_cont(abs(later - command), 0.95), 6) AS p95, round(avg(later - command), 6) + 0.0 AS mean FROM e GROUP BY 1""",
    "event_fit": """WITH f AS (SELECT l_linenumber, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_linenumber, round(slope, 4) AS slope, round(intercept, 4) AS intercept, n, round(sqrt(avg((l_extendedprice - intercept - slope * l_quantity) ** 2)), 4) AS rms FROM lineitem JOIN f USING (l_linenumber) GROUP BY l_linenumber, slope, intercept, n""",
    "training_windows": f"""WITH e AS (SELECT user_id::VARCHAR AS episode_id, event_type AS modality, epoch_us(ts) AS t FROM events),
ep AS (SELECT episode_id, min(t) AS start, max(t) AS stop FROM e GROUP BY 1),
st AS (SELECT episode_id, start, (stop - start) // {6 * HOUR} AS last FROM ep),
w AS (SELECT episode_id, start, unnest(range(0, last - 6 + 2, 3)) AS win FROM st WHERE last - 5 >= 0),
p AS (SELECT episode_id, win, modality, start + (win + j) * {6 * HOUR} AS t FROM w, range(6) r(j) JOIN (SELECT DISTINCT episode_id AS eid, modality FROM e WHERE modality IN ('click', 'view')) k ON k.eid = episode_id),
f AS (SELECT p.*, e.t AS mt FROM p ASOF LEFT JOIN (SELECT DISTINCT episode_id, modality, t FROM e) e ON p.episode_id = e.episode_id AND p.modality = e.modality AND p.t >= e.t),
g AS (SELECT episode_id, win AS "window", count(*) FILTER (mt IS NULL OR t - mt > {48 * HOUR}) AS missing FROM f GROUP BY 1, 2)
SELECT episode_id, "window", missing, CASE WHEN row_number() OVER (PARTITION BY episode_id ORDER BY "window") > 20 THEN 'skipped' WHEN missing = 0 THEN 'pass' ELSE 'unknown' END AS status FROM g""",
    "interval_join": f"""SELECT p.user_id, p.event_id, e.event_id AS error_id FROM {_ev("purchase")} p JOIN {_ev("error")} e ON p.user_id = e.user_id AND p.t >= e.t AND p.t < e.t + {2 * HOUR}""",
    "segments": f"""WITH {D.EVENTS}, z AS (SELECT *, lag(t) OVER (PARTITION BY episode_id, stream ORDER BY row_idx) AS pt FROM samples),
s AS (SELECT *, sum(CASE WHEN t - pt <= 21600 THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id, stream ORDER BY row_idx) AS segment FROM z),
d AS (SELECT *, (v - lag(v) OVER w) / (t - lag(t) OVER w) AS d FROM s WINDOW w AS (PARTITION BY episode_id, stream, segment ORDER BY row_idx)),
f AS (SELECT *, sign(d) * sign(lag(d) OVER (PARTITION BY episode_id, stream, segment ORDER BY row_idx)) < 0 AS turn FROM d)
SELECT episode_id, stream, segment, count(*) AS n, round(max(abs(d)), 4) AS max_speed, count(*) FILTER (turn) AS turns FROM f GROUP BY ALL""",
    "cross_correlation": f"WITH {_XC} SELECT g, lag, n, round(r, 6) + 0.0 AS r FROM xc",
    "best_lag": f"""WITH {_XC}, c AS (SELECT *, lag(r) OVER w AS a, lead(r) OVER w AS b FROM xc WINDOW w AS (PARTITION BY g ORDER BY lag)),
t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(r, 9) DESC, lag) AS k FROM c)
SELECT g, lag, round(r, 5) AS r, round(lag + coalesce(CASE WHEN a - 2 * r + b < 0 THEN 0.5 * (a - b) / (a - 2 * r + b) ELSE 0 END, 0), 5) AS refined FROM t WHERE k = 1""",
    "longest_run": f"""WITH {D.ARM}, p AS (SELECT *, v = lag(v) OVER {_W} AS same FROM samples), i AS (SELECT *, row_idx - row_number() OVER {_W} AS g FROM p WHERE same),
r AS (SELECT episode_id, stream, channel, min(row_idx) AS start, max(row_idx) AS stop, count(*) AS length FROM i GROUP BY episode_id, stream, channel, g)
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY episode_id, stream, channel ORDER BY length DESC, start) AS k FROM r) WHERE k = 1""",
    "flat_runs": f"""WITH {D.EVENTS}, p AS (SELECT *, v = lag(v) OVER {_W} AS same FROM samples), i AS (SELECT *, row_idx - row_number() OVER {_W} AS g FROM p WHERE same)
SELECT episode_id, stream, channel, min(row_idx) AS start, max(row_idx) AS stop, count(*) AS length FROM i GROUP BY episode_id, stream, channel, g""",
    "detrend": f"WITH {D.EVENTS} SELECT episode_id, stream, channel, row_idx, round(v - avg(v) OVER (PARTITION BY episode_id, stream, channel ORDER BY row_idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 6) + 0.0 AS detrended FROM samples",
    "neighbour_max": f"WITH {D.EVENTS} SELECT episode_id, stream, channel, row_idx, round(max(v) OVER (PARTITION BY episode_id, stream, channel ORDER BY row_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) + 0.0 AS near_max FROM samples",
    "robust_z": f"""WITH {D.EVENTS}, m AS (SELECT episode_id, stream, channel, median(v) AS m FROM samples GROUP BY ALL), d AS (SELECT s.*, m, abs(v - m) AS d FROM samples s JOIN m USING (episode_id, stream, channel)),
u AS (SELECT episode_id, stream, channel, median(d) AS mad, median(d) FILTER (d > 0) AS near FROM d GROUP BY ALL)
SELECT episode_id, stream, channel, row_idx, round(coalesce((v - m) / nullif(CASE WHEN mad > 0 THEN 1.4826 * mad ELSE near END, 0), 0), 6) + 0.0 AS z FROM d JOIN u USING (episode_id, stream, channel)""",
    "local_ratio": f"""WITH {D.EVENTS}, q AS (SELECT episode_id, stream, channel, quantile_cont(v, 0.25) AS fl FROM samples GROUP BY ALL),
a AS (SELECT *, list_concat(coalesce(list(v) OVER (PARTITION BY episode_id, stream, channel ORDER BY row_idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), []), coalesce(list(v) OVER (PARTITION BY episode_id, stream, channel ORDER BY row_idx ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), [])) AS near FROM samples)
SELECT episode_id, stream, channel, row_idx, round(v / nullif(greatest(list_median(near), fl), 0), 6) AS ratio FROM a JOIN q USING (episode_id, stream, channel)""",
    "angle_unwrap": f"""WITH {D.EVENTS}, a AS (SELECT episode_id, stream, channel, row_idx, (native % {24 * HOUR}) * {2 * math.pi / (24 * HOUR)!r} AS v FROM samples),
j AS (SELECT *, coalesce(-round_even((v - lag(v) OVER {_W}) / {2 * math.pi!r}, 0), 0) AS k FROM a)
SELECT episode_id, stream, channel, row_idx, round(v + sum(k) OVER {_W} * {2 * math.pi!r}, 4) + 0.0 AS unwrapped FROM j""",
    "monotonic_fraction": f"WITH {D.EVENTS}, p AS (SELECT *, lag(v) OVER {_W} AS p FROM samples) SELECT episode_id, stream, channel, round(avg(CASE WHEN v >= p THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM p WHERE p IS NOT NULL GROUP BY ALL",
    "change_point": """WITH d AS (SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS x FROM events GROUP BY ALL),
r AS (SELECT event_type, row_number() OVER w AS k, count(*) OVER (PARTITION BY event_type) AS n, sum(x) OVER w AS s, sum(x * x) OVER w AS q, sum(x) OVER (PARTITION BY event_type) AS ss, sum(x * x) OVER (PARTITION BY event_type) AS qq FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)),
c AS (SELECT event_type, k, (q - s * s / k) + (qq - q - (ss - s) * (ss - s) / (n - k)) AS cost FROM r WHERE k >= 5 AND n - k >= 5)
SELECT event_type, k AS split, round(cost, 4) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(cost, 9), k) AS p FROM c) WHERE p = 1""",
    "support_intervals": f"WITH {D.EVENTS}, far AS ({_FAR}), {_MERGE} SELECT * FROM cover",
    "split_intervals": f"""WITH {D.EVENTS}, far AS ({_FAR}), {_MERGE}, b AS (SELECT DISTINCT episode_id, stream, unnest([start, stop]) AS start FROM far),
p AS (SELECT *, lead(start) OVER (PARTITION BY episode_id, stream ORDER BY start) AS stop FROM b)
SELECT p.* FROM p JOIN cover c USING (episode_id, stream) WHERE p.stop IS NOT NULL AND p.start >= c.start AND p.stop <= c.stop""",
    "number_runs": """SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, CASE WHEN min(o_orderkey) = max(o_orderkey) THEN min(o_orderkey)::VARCHAR ELSE min(o_orderkey) || '-' || max(o_orderkey) END AS label
FROM (SELECT *, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)) GROUP BY o_custkey, g""",
    "regularity": f"""WITH {D.EVENTS}, g AS (SELECT s.episode_id, s.stream, (native - lag(native) OVER (PARTITION BY s.episode_id, s.stream ORDER BY row_idx)) * scale AS gap FROM samples s JOIN streams USING (episode_id, stream)),
m AS (SELECT episode_id, stream, median(gap) AS med FROM g WHERE gap IS NOT NULL GROUP BY ALL), n AS (SELECT g.episode_id, g.stream, first(med) AS med, avg(CASE WHEN abs(gap - med) <= 0.3 * med THEN 1.0 ELSE 0.0 END) AS near FROM g JOIN m USING (episode_id, stream) WHERE gap IS NOT NULL GROUP BY ALL)
SELECT episode_id, stream, round(med, 6) AS median_gap, round(near, 6) AS near_share, med > 0 AND near >= 0.8 AS regular FROM n""",
    "violation_rows": """WITH g AS (SELECT 'all' AS episode_id, event_type AS stream, event_id * 7919 % 1000003 AS row_idx, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id * 7919 % 1000003) AS gap FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY row_idx) AS k FROM g WHERE gap <= 0)
SELECT episode_id, stream, row_idx, CASE WHEN gap = 0 THEN 'repeated' ELSE 'backwards' END AS kind FROM b WHERE k <= 100""",
}
