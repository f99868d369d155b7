"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_bayes, queries_decontaminate, queries_lm, queries_near_dedup, queries_quality, queries_quotations, queries_sentencepiece, queries_substring, queries_suffix, queries_urls

_MODULES = (queries_bayes, queries_decontaminate, queries_lm, queries_near_dedup, queries_quality, queries_quotations, queries_sentencepiece, queries_substring, queries_suffix, queries_urls)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for m in _MODULES for k, f in vars(m).items() if k.startswith("op") and callable(f) and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
