"""Queries across episodes, of scalar functions and of set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scalars as C
from ..operators import cohort as H
from . import datasets as D


def _vectors(spark, sf_dir):
    return D.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def exact_copies(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return H.exact_copies(d, "doc_id", "key")


def payload_keys(spark, sf_dir):
    return H.payload_keys(D.arm_samples(spark, sf_dir)).select("episode_id", "stream", "channel", "n")


def near_copies(spark, sf_dir):
    return D.rounded(H.near_copies(_vectors(spark, sf_dir), limit=1.3))


def nearest_partners(spark, sf_dir):
    return D.rounded(H.nearest_partners(H.near_copies(_vectors(spark, sf_dir), limit=1.3, most=5), 5))


def motion_variation(spark, sf_dir):
    return D.rounded(H.rms_pairwise(_vectors(spark, sf_dir)))


def resampled(spark, sf_dir):
    s = _vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("episode_id"), F.posexplode("x").alias("row_idx", "v"))
    return D.rounded(H.resampled(s, ("episode_id",)))


def pooled_moments(spark, sf_dir):
    p = D.table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.var_pop("o_totalprice").alias("var"))
    return D.rounded(H.pooled(p, ["o_orderstatus"]), 3)


def camera_fences(spark, sf_dir):
    return D.rounded(H.fences(D.table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice"), 4)


def outside_fences(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return H.outside_fences(e, ["event_type"], "value")


def leave_one_out(spark, sf_dir):
    return D.rounded(H.median_without_self(D.table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_retailprice"), 4)


def container_hints(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return H.container_hints(e, ["event_type"], "event_id", "value")


def cohort_histogram(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("x"))
    return H.histogram(e, ["event_type"], "x")


def cohort_entropy(spark, sf_dir):
    return D.rounded(H.entropy(cohort_histogram(spark, sf_dir), ["event_type"]))


def effective_dimensions(spark, sf_dir):
    return D.rounded(H.effective_dimensions(_vectors(spark, sf_dir)), 5)


def cohort_outliers(spark, sf_dir):
    s = D.table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_suppkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in ("l_quantity", "l_extendedprice", "l_discount")])).alias("f"))
    s = s.groupBy("l_linenumber", "id", "f.feature").agg(F.round(F.avg("f.x"), 6).alias("x"))
    return D.rounded(H.cohort_outliers(s, ["l_linenumber"], "id"), 4)


def session_bootstrap(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select(F.col("event_type").alias("group"), F.col("user_id").alias("session"), F.col("value").alias("x"))
    return H.session_bootstrap(e)


def camera_pairs(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), F.col("event_type").alias("camera"))
    return H.camera_pairs(e)


def shared_footage(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), F.col("source").alias("camera"), F.col("doc_id").alias("episode_id"))
    return H.shared_footage(d)


def study_summary(spark, sf_dir):
    """Quality is the truth, toxic the decision."""
    s = D.table(spark, sf_dir, "labels")
    return s.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def benign_rate(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    each = e.groupBy("event_type", "user_id").agg(F.max("value").alias("top"))
    return D.rounded(each.groupBy("event_type").agg(F.count("*").alias("episodes"), F.sum((F.col("top") > 250).cast("int")).alias("firing"), F.avg((F.col("top") > 250).cast("double")).alias("rate")))


def layout_reconcile(spark, sf_dir):
    """Orders are the index, order lines the data: a full outer join of what either says."""
    index = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode"), F.lit(True).alias("listed"))
    data = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count("*").alias("rows"), F.min("l_linenumber").alias("from_row"), (F.max("l_linenumber") + 1).alias("to_row"))
    both = index.join(data, "episode", "full_outer")
    state = F.when(F.col("listed").isNull(), "not in metadata").when(F.col("rows").isNull(), "no rows").otherwise("found")
    return both.select("episode", "rows", "from_row", "to_row", state.alias("state"))


def orphan_episodes(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode")).join(D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode")), "episode", "left_anti")


def index_range_mismatch(spark, sf_dir):
    """Lines that the index would expect from the first and last against those there are."""
    data = D.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("length"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    fields = (F.col("lo") != 1).cast("int") + (F.col("hi") - F.col("lo") + 1 != F.col("length")).cast("int")
    return data.select("l_orderkey", fields.alias("mismatches"))


def task_missing(spark, sf_dir):
    """A system turn is a conversation's task."""
    c = D.table(spark, sf_dir, "conversations")
    tasks = c.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "system", F.col("text"))).alias("tasks"))
    return tasks.select("conv_id", (~F.exists("tasks", lambda x: F.trim(x) != "")).alias("missing"))


def report_diff(spark, sf_dir):
    """Two policies' verdicts on the same events, by address."""
    e = D.table(spark, sf_dir, "events")
    old = e.where("event_type <> 'error'").groupBy("user_id").agg(F.sum((F.col("value") > 100).cast("int")).alias("old"))
    new = e.where("event_type <> 'click'").groupBy("user_id").agg(F.sum((F.col("value") > 100).cast("int")).alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return old.join(new, "user_id", "full_outer").withColumn("state", state)


def set_operations(spark, sf_dir):
    """Customers with orders, with none, and nations of customers or suppliers only."""
    c, o = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    n, s = D.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), D.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"both": c.intersect(o), "none": c.exceptAll(o.distinct()), "either": n.union(s).distinct(), "only_customer": n.distinct().exceptAll(s.distinct()), "only_supplier": s.distinct().exceptAll(n.distinct())}
    rows = None
    for name, part in parts.items():
        one = part.agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("total")).withColumn("part", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def spread_sample(spark, sf_dir):
    """Nine places evenly over each customer's orders, both ends included; halves to even."""
    from pyspark.sql import Window

    o = D.table(spark, sf_dir, "orders")
    rows = o.select("o_custkey", "o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("i"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))
    size = rows.groupBy("o_custkey").agg(F.first("n").alias("n"))
    return C.spread_places(size, 9).join(rows.drop("n"), ["o_custkey", "i"]).select("o_custkey", "i", "o_orderkey")


def name_normalise(spark, sf_dir):
    d = D.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", "p_brand", "p_type", "p_name").alias("name"))
    return d.select("p_partkey", N.collapse(N.last_segment(F.col("name"))).alias("collapsed"))


def unit_from_name(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.element_at(F.array(*map(F.lit, ("_ms", " (s)", "_in_us", " [ns]", "_x"))), (F.col("event_id") % 5 + 1).cast("int"))).alias("name"))
    return e.select("event_id", N.unit_of_name(F.col("name")).alias("unit"))


def unit_from_magnitude(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e3).alias("gap"))
    return o.select("o_orderkey", N.unit_of_magnitude(F.pow(F.col("gap"), 2)).alias("unit"))


def json_flatten(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "value"))


def significant_digits(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.significant(F.col("o_totalprice") / 7, 4).alias("x"))


def content_digest(spark, sf_dir):
    o = D.table(spark, sf_dir, "nation")
    return o.select("n_nationkey", F.sha2(F.to_json(F.struct("n_name", "n_nationkey", "n_regionkey")), 256).alias("digest"))


def quaternion_angle(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    dot = F.get("x", F.lit(0)) * F.get("x", F.lit(1)) + F.get("x", F.lit(2)) * F.get("x", F.lit(3))
    return D.rounded(v.select("vec_id", C.rotation_angle(dot).alias("angle")))


_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)"
_P = f"""{_V}, e AS (SELECT label, p, x[p] AS c FROM v, range(1, 65) r(p)), sc AS (SELECT label, sqrt(avg(var)) AS s FROM (SELECT label, p, var_pop(c) AS var FROM e GROUP BY ALL) GROUP BY 1),
pairs AS (SELECT label, a.vec_id AS a, b.vec_id AS b, list_distance(a.x, b.x) / 8 / s AS nrmse FROM v a JOIN v b USING (label) JOIN sc USING (label) WHERE a.vec_id < b.vec_id), near AS (SELECT * FROM pairs WHERE nrmse <= 1.3)"""
_HIST = "h AS (SELECT event_type, CASE WHEN value / 100 < 0 OR value / 100 > 1 THEN -1 ELSE least(floor(value / 100 * 10), 9)::INT END AS bin, count(*) AS n FROM events GROUP BY ALL)"

QUERIES = {
    f.__name__: f
    for f in (
        exact_copies,
        payload_keys,
        near_copies,
        nearest_partners,
        motion_variation,
        resampled,
        pooled_moments,
        camera_fences,
        outside_fences,
        leave_one_out,
        container_hints,
        cohort_histogram,
        cohort_entropy,
        effective_dimensions,
        cohort_outliers,
        session_bootstrap,
        camera_pairs,
        shared_footage,
        study_summary,
        benign_rate,
        layout_reconcile,
        orphan_episodes,
        index_range_mismatch,
        task_missing,
        report_diff,
        set_operations,
        spread_sample,
        name_normalise,
        unit_from_name,
        unit_from_magnitude,
        json_flatten,
        significant_digits,
        quaternion_angle,
        content_digest,
    )
}
SQL = {
    "exact_copies": "SELECT sha256(text) AS key, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "payload_keys": f"WITH {D.ARM} SELECT episode_id, stream, channel, count(*) AS n FROM samples GROUP BY ALL",
    "near_copies": f"WITH {_P} SELECT label, a, b, round(nrmse, 6) AS nrmse FROM near",
    "nearest_partners": f"WITH {_P}, t AS (SELECT a AS id, b AS partner, nrmse FROM near UNION ALL SELECT b, a, nrmse FROM near) SELECT id, partner, round(nrmse, 6) AS nrmse, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nrmse, partner) AS place FROM t) WHERE place <= 5",
    "motion_variation": f"WITH {_P} SELECT label, round(sqrt(2 * avg(var)), 6) AS variation FROM (SELECT label, p, var_samp(c) AS var FROM e GROUP BY ALL) GROUP BY 1",
    "resampled": f"WITH {_V}, g AS (SELECT vec_id, x, k, k * 63 / 31.0::DOUBLE AS pos FROM v, range(32) r(k)) SELECT vec_id::VARCHAR AS episode_id, 64 AS n, k, round(x[floor(pos)::INT + 1] + (pos - floor(pos)) * (x[least(floor(pos)::INT + 1, 63) + 1] - x[floor(pos)::INT + 1]), 6) + 0.0 AS x FROM g",
    "pooled_moments": "SELECT o_orderstatus, round(avg(o_totalprice), 3) AS mean, count(*) AS n, round(stddev_pop(o_totalprice), 3) AS std FROM orders GROUP BY 1",
    "camera_fences": "WITH q AS (SELECT p_brand, count(*) AS n, quantile_cont(p_retailprice, 0.25) AS a, median(p_retailprice) AS m, quantile_cont(p_retailprice, 0.75) AS c FROM part GROUP BY 1) SELECT p_brand, n, round(a, 4) AS q1, round(m, 4) AS median, round(c, 4) AS q3, round(a - 1.5 * (c - a), 4) AS low, round(c + 1.5 * (c - a), 4) AS high FROM q",
    "outside_fences": "WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM events GROUP BY 1) SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE n >= 5 AND (value < a - 1.5 * (c - a) OR value > c + 1.5 * (c - a))",
    "leave_one_out": "SELECT p.p_brand, p.p_partkey, round(p.p_retailprice, 4) AS p_retailprice, round(median(q.p_retailprice), 4) AS others FROM part p JOIN part q ON p.p_brand = q.p_brand AND p.p_partkey <> q.p_partkey GROUP BY ALL",
    "container_hints": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
l AS (SELECT event_type, list(value ORDER BY value, event_id) AS x FROM events GROUP BY 1),
o AS (SELECT event_type, event_id, value, n, (x[CASE WHEN n // 2 >= k THEN n // 2 + 1 ELSE n // 2 END] + x[CASE WHEN (n + 1) // 2 >= k THEN (n + 1) // 2 + 1 ELSE (n + 1) // 2 END]) / 2 AS others FROM r JOIN l USING (event_type))
SELECT event_type, event_id, CASE WHEN value / others < 0.25 THEN 'low' ELSE 'high' END AS hint FROM o WHERE n >= 5 AND (value / others < 0.25 OR value / others > 3)""",
    "cohort_histogram": f"WITH {_HIST} SELECT * FROM h",
    "cohort_entropy": f"WITH {_HIST}, t AS (SELECT event_type, sum(n) AS t FROM h WHERE bin >= 0 GROUP BY 1) SELECT event_type, round(-sum(n / t * ln(n / t)), 6) AS entropy FROM h JOIN t USING (event_type) WHERE bin >= 0 GROUP BY 1",
    "effective_dimensions": f"WITH {_V}, c AS (SELECT label, i, j, covar_samp(x[i], x[j]) AS c FROM v, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL) SELECT label, round(pow(sum(c) FILTER (i = j), 2) / sum(c * c), 5) AS dimensions FROM c GROUP BY 1",
    "cohort_outliers": """WITH s AS (SELECT l_linenumber, l_suppkey AS id, f.n AS feature, round(avg(f.x), 6) AS x FROM (SELECT l_linenumber, l_suppkey, unnest([{'n': 'l_quantity', 'x': l_quantity}, {'n': 'l_extendedprice', 'x': l_extendedprice}, {'n': 'l_discount', 'x': l_discount}]) AS f FROM lineitem) GROUP BY ALL),
m AS (SELECT l_linenumber, feature, median(x) AS m, count(*) AS n FROM s GROUP BY ALL), d AS (SELECT s.*, m, n, abs(x - m) AS d FROM s JOIN m USING (l_linenumber, feature)), a AS (SELECT l_linenumber, feature, median(d) AS mad FROM d GROUP BY ALL)
SELECT l_linenumber, id, round(sqrt(avg(pow((x - m) / (1.4826 * mad), 2))), 4) AS distance FROM d JOIN a USING (l_linenumber, feature) WHERE mad > 0 AND n >= 5 GROUP BY ALL""",
    "camera_pairs": "WITH c AS (SELECT DISTINCT user_id, event_type FROM events) SELECT x.event_type AS a, y.event_type AS b, count(*) AS episodes FROM c x JOIN c y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY ALL",
    "shared_footage": "SELECT sha256(text) AS hash, count(DISTINCT source) AS cameras, count(DISTINCT doc_id) AS episodes FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "study_summary": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "benign_rate": "SELECT event_type, count(*) AS episodes, count(*) FILTER (top > 250) AS firing, round(avg(CASE WHEN top > 250 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT event_type, user_id, max(value) AS top FROM events GROUP BY ALL) GROUP BY 1",
    "layout_reconcile": "WITH d AS (SELECT l_orderkey AS episode, count(*) AS rows, min(l_linenumber) AS from_row, max(l_linenumber) + 1 AS to_row FROM lineitem GROUP BY 1) SELECT coalesce(o.o_orderkey, d.episode) AS episode, rows, from_row, to_row, CASE WHEN o.o_orderkey IS NULL THEN 'not in metadata' WHEN rows IS NULL THEN 'no rows' ELSE 'found' END AS state FROM orders o FULL JOIN d ON o.o_orderkey = d.episode",
    "orphan_episodes": "SELECT o_orderkey AS episode FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey",
    "index_range_mismatch": "SELECT l_orderkey, (min(l_linenumber) <> 1)::INT + (max(l_linenumber) - min(l_linenumber) + 1 <> count(*))::INT AS mismatches FROM lineitem GROUP BY 1",
    "task_missing": "SELECT conv_id, count(*) FILTER (role = 'system' AND trim(text) <> '') = 0 AS missing FROM conversations GROUP BY 1",
    "report_diff": """WITH o AS (SELECT user_id, count(*) FILTER (value > 100) AS old FROM events WHERE event_type <> 'error' GROUP BY 1), n AS (SELECT user_id, count(*) FILTER (value > 100) AS new FROM events WHERE event_type <> 'click' GROUP BY 1)
SELECT coalesce(o.user_id, n.user_id) AS user_id, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old = new THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.user_id = n.user_id""",
    "set_operations": """WITH b AS (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders), z AS (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders), e AS (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier),
x AS (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier), y AS (SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer)
SELECT part, count(k) AS n, coalesce(sum(k), 0)::BIGINT AS total FROM (SELECT 'both' AS part UNION ALL SELECT 'none' UNION ALL SELECT 'either' UNION ALL SELECT 'only_customer' UNION ALL SELECT 'only_supplier') p
LEFT JOIN (SELECT 'both' AS part, k FROM b UNION ALL SELECT 'none', k FROM z UNION ALL SELECT 'either', k FROM e UNION ALL SELECT 'only_customer', k FROM x UNION ALL SELECT 'only_supplier', k FROM y) q USING (part) GROUP BY part""",
    "spread_sample": """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
s AS (SELECT DISTINCT o_custkey, CASE WHEN n = 1 THEN 0 ELSE round_even(k * (n - 1) / (least(9, n) - 1.0::DOUBLE), 0)::BIGINT END AS i FROM r, range(9) t(k) WHERE k < least(9, n)) SELECT o_custkey, i, o_orderkey FROM r JOIN s USING (o_custkey, i)""",
    "name_normalise": "SELECT p_partkey, trim(regexp_replace(lower(list_extract(string_split(p_brand || '.' || p_type || '.' || p_name, '.'), -1)), '[^a-z0-9]+', '_', 'g'), '_') AS collapsed FROM part",
    "unit_from_name": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'us' WHEN 3 THEN 'ns' END AS unit FROM events",
    "unit_from_magnitude": "WITH g AS (SELECT o_orderkey, pow(o_totalprice / 1e3, 2) AS g FROM orders) SELECT o_orderkey, CASE WHEN g <= 0 THEN NULL WHEN g < 1 THEN 's' WHEN g < 1e3 THEN 'ms' WHEN g < 1e6 THEN 'us' ELSE 'ns' END AS unit FROM g",
    "json_flatten": "SELECT event_id, unnest(json_keys(props)) AS key, (json_extract(props, '$.' || unnest(json_keys(props))))::INT AS value FROM events",
    "significant_digits": "SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN 0 ELSE round(o_totalprice / 7 / pow(10, floor(log10(abs(o_totalprice / 7))) - 3)) * pow(10, floor(log10(abs(o_totalprice / 7))) - 3) END AS x FROM orders",
    "quaternion_angle": f"WITH {_V} SELECT vec_id, round(2 * acos(least(abs(x[1] * x[2] + x[3] * x[4]), 1)), 6) AS angle FROM v",
    "content_digest": """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""",
}
