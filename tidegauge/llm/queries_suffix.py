"""The query of suffix-array deduplication and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._spark import table
from .suffix_dedup import repeated_strings_report


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings_report(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)


#: Strings as hexadecimal digits, two a byte, numbered by where they start.
SQL = {
    "op2_suffix_dedup": """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, CAST(length(x) // 2 - 399 AS BIGINT))) AS i FROM d WHERE length(x) >= 800)),
s AS MATERIALIZED (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c >= 2),
e AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS fresh FROM s),
n AS (SELECT r, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM e),
runs AS MATERIALIZED (SELECT r, k, min(i) AS a, max(i) + 400 AS b FROM n GROUP BY r, k),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM runs),
tail AS (SELECT r, max(b) AS z, count(*) AS n_spans, sum(b - a) AS n_removed FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS t FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(t, '') || substr(x, 2 * CAST(coalesce(z, 0) AS BIGINT) + 1))) AS kept_sha256
FROM d LEFT JOIN tail USING (r) LEFT JOIN kept USING (r)
"""
}
