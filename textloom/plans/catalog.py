"""The registry of queries and of the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans.inputs import check_sql
from textloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
PARTS = ("text", "events", "tasks", "identifiers", "corpus", "logs", "files")


def query(check: str | None = None, name: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(prepare(spark), folder)

        QUERIES[key] = run
        if check is not None:
            CHECKS[key] = check_sql(check)
        return f

    return register


def load_all() -> None:
    for part in PARTS:
        importlib.import_module(f"textloom.plans.{part}_queries")
