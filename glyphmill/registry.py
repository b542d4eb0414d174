"""All named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.plans import corpus, evaluation, flows, labels, logs, splits

_ALL = {k: v for module in (labels, splits, evaluation, logs, corpus, flows) for k, v in module.QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
