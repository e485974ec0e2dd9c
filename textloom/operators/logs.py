"""Application logs: search, failure causes, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")

# The only causes that are named, with the phase or text that tells them, and a hint.
CAUSES = (
    ("jdk-required", r"(?i)no system java compiler|getSystemJavaCompiler\(\) (is|returned) null", "Run on a JDK, not a JRE."),
    ("missing-shared-lib", r"(?i)library-ref .* did not resolve", "Deploy the library or set the library folder."),
    ("unresolved-placeholder", r"\$\{[^}]+\}", "The named property is missing; add it or override it."),
    ("datasource-unreachable", r"(?i)hikari|validation connection", "Check alias, admin folder and credentials."),
    ("duplicate-framework-class", r"(ClassCastException|LinkageError).*(springframework|hibernate|jersey|javax\.|jakarta\.)", "A framework class leaked into the application loader."),
    ("compile-error", r"(?i)compile failed|compilation failed", "Fix the source at the given place."),
    ("missing-codegen", r"(?i)generated class .* (is )?(absent|missing|not found)", "Generate the sources first."),
)


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.upper(level))


def search_logs(
    df: DataFrame,
    app: str | None = None,
    level: str | None = None,
    logger: str | None = None,
    since: int | None = None,
    contains: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Log records, newest first. ``level`` is the lowest level wanted."""
    out = df
    if app is not None:
        out = out.where(F.col("app") == app)
    if level is not None:
        out = out.where(level_rank(F.col("level")) >= level_rank(F.lit(level)))
    if logger is not None:
        out = out.where(F.col("logger") == logger)
    if since is not None:
        out = out.where(F.col("t") > since)
    if contains is not None:
        out = out.where(F.contains(F.col("message"), F.lit(contains)))
    return out if limit is None else out.orderBy(F.desc("t"), F.desc("event_id")).limit(limit)


def classify_failure(df: DataFrame, text: str = "raw") -> DataFrame:
    """Add ``cause`` and ``hint``. Whatever is not certain stays ``unclassified``."""
    cause, hint = F.lit("unclassified"), F.lit(None).cast("string")
    for code, pattern, advice in reversed(CAUSES):
        hit = F.col(text).rlike(pattern)
        cause, hint = F.when(hit, F.lit(code)).otherwise(cause), F.when(hit, F.lit(advice)).otherwise(hint)
    return df.withColumns({"cause": cause, "hint": hint})


def decision_log(df: DataFrame, app: str | None = None, since: int | None = None) -> DataFrame:
    out = df if app is None else df.where(F.col("app") == app)
    return out if since is None else out.where(F.col("t") > since)
