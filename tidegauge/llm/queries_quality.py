"""The query of the quality rules and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ._spark import table
from .quality import DEFAULT, apply_policy, quality_ledger


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return apply_policy(ledger, DEFAULT).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals", "n_letters", "failed_bits", "policy")


#: Measurements, bits and verdicts as quality_ledger() and apply_policy() make them; {docs} has doc_id and text.
LEDGER = r"""
q1 AS (SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l,
    regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS b
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM {docs})),
q2 AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(b) AS BIGINT) AS word_chars,
    CAST(length(b) - length(regexp_replace(b, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS BIGINT) AS n_letters
  FROM q1),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM q1 WHERE len(w) >= 5)),
g2 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g2) GROUP BY doc_id),
q3 AS (SELECT q2.*, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM q2 LEFT JOIN r USING (doc_id)),
q4 AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_capitals > n_letters THEN 64 ELSE 0 END) + (CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END) AS BIGINT) AS failed_bits
  FROM q3),
ledger AS (SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, '2024.1' AS policy FROM q4)
"""

SQL = {
    "op6_quality_rules": "WITH "
    + LEDGER.replace("{docs}", "documents")
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_capitals, n_letters, failed_bits, policy FROM ledger"
}
