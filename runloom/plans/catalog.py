"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runloom.plans import nested, pipelines, ranking, relational, resampling, sequences, text

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (nested, relational, ranking, resampling, sequences, text, pipelines)
FLAGSHIP: Query = ranking.QUERIES["auroc_within_group"][0]


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, (_, sql) in m.QUERIES.items() if sql}
