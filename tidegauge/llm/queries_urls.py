"""The query of the URL filters and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._spark import table
from .urls import BLOCKED_HOSTS, RULES, filter_urls


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_NAMES = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)

SQL = {
    "op4_url_filters": f"""
WITH rules(rh, rp, rv) AS (VALUES {_VALUES}),
names(nh) AS (VALUES {_NAMES}),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)\\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
      FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
l AS (SELECT DISTINCT page_id FROM p JOIN names ON host = nh OR ends_with(host, '.' || nh))
SELECT p.page_id, host, path, rule, coalesce(rv, CASE WHEN l.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       l.page_id IS NOT NULL AS listed
FROM p LEFT JOIN f ON p.page_id = f.page_id LEFT JOIN l ON p.page_id = l.page_id
"""
}
