"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import documents, retrieval

_MODULES = (retrieval, documents)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
