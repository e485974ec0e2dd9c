"""The functions by name, for SQL users: ``register_all(spark)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from textloom.functions import folding, sql
from textloom.operators.corpus import line_changes, unified_text
from textloom.operators.tasks import parse_calls, tool_calls_in

SCALARS = {
    "normalize_text": folding.normalize_text,
    "fold_key": folding.fold_key,
    "nfc_lower": folding.nfc_lower,
    "tool_calls": tool_calls_in,
    "line_changes": line_changes,
    "unified_text": unified_text,
}


class ExtractToolCalls:
    def eval(self, text: str):
        for i, c in enumerate(parse_calls(text), 1):
            yield i, c["verb"], c["kind"], c["tool"], c["args"]


def register_all(spark: SparkSession) -> list[str]:
    """Register all functions, native ones and those in Python; returns their names."""
    for name, f in SCALARS.items():
        spark.udf.register(name, f)
    spark.udtf.register("extract_tool_calls", udtf(ExtractToolCalls, returnType="call INT, verb STRING, kind STRING, tool STRING, args MAP<STRING, STRING>"))
    return [*SCALARS, "extract_tool_calls", *sql.create_all(spark)]
