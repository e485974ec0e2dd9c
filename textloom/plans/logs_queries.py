"""Queries over application logs, delimited logs and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import logs
from textloom.plans.catalog import query
from textloom.plans.inputs import load
from textloom.sources import readers, writers

_PLACE = "app, event_id, t, level, logger, message"


@query(f"""SELECT {_PLACE} FROM $applog WHERE app = 'app2' AND level IN ('WARN', 'ERROR', 'FATAL') AND t > 1705000000000
           AND contains(message, 'value 1') ORDER BY t DESC, event_id DESC LIMIT 100""")
def search_logs(spark, folder):
    return logs.search_logs(load(spark, folder, "applog"), "app2", "WARN", None, 1705000000000, "value 1", 100).select(*_PLACE.split(", "))


@query(f"SELECT {_PLACE} FROM $applog WHERE level IN ('INFO', 'WARN', 'ERROR') AND logger = 'ev.view'")
def search_logs_by_logger(spark, folder):
    return logs.search_logs(load(spark, folder, "applog"), level="INFO", logger="ev.view").select(*_PLACE.split(", "))


@query("""SELECT cause, count(*) AS n FROM (SELECT CASE
            WHEN contains(raw, 'no system Java') THEN 'jdk-required' WHEN contains(raw, 'library-ref') THEN 'missing-shared-lib' WHEN contains(raw, '${') THEN 'unresolved-placeholder'
            WHEN contains(raw, 'Hikari') THEN 'datasource-unreachable' WHEN contains(raw, 'ClassCastException') THEN 'duplicate-framework-class'
            WHEN contains(raw, 'COMPILE') THEN 'compile-error' WHEN contains(raw, 'generated class') THEN 'missing-codegen' ELSE 'unclassified' END AS cause
          FROM $failures) x GROUP BY cause""")
def classify_failures(spark, folder):
    return logs.classify_failure(load(spark, folder, "failures")).groupBy("cause").agg(F.count("*").alias("n"))


@query("SELECT app, event_id, t, logger AS phase, level AS decision FROM $applog WHERE app = 'app1' AND t > 1705500000000")
def decision_log(spark, folder):
    rows = load(spark, folder, "SELECT app, event_id, t, logger AS phase, level AS decision FROM $applog")
    return logs.decision_log(rows, "app1", 1705500000000)


@query("""SELECT CAST(conv_id AS STRING) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM
          (SELECT conv_id, turn, role, regexp_replace(text, '[\\x00-\\x20]+$', '') AS text FROM $conversations) x WHERE text <> ''""")
def read_conversation_records(spark, folder):
    turns = load(spark, folder, "SELECT CAST(conv_id AS STRING) AS conv_id, turn, role, text FROM $conversations")
    lines = writers.conversation_lines(turns)
    files = lines.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "value"))), lambda x: x["value"]), readers.RECORD_END), F.lit(readers.RECORD_END)).alias("value"))
    return readers.conversation_records(files)


@query("SELECT event_id, t, message FROM $applog")
def read_debug_records(spark, folder):
    rows = load(spark, folder, "applog")
    stamp = F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd HH:mm:ss.SSS")
    lines = rows.select(F.concat(F.lit("["), stamp, F.lit("] "), F.col("event_id").cast("string"), F.lit(" "), "message").alias("value"))
    out = readers.debug_records(lines)
    return out.select(
        F.substring_index("message", " ", 1).cast("bigint").alias("event_id"), F.unix_millis("ts").alias("t"), F.regexp_replace("message", "^[0-9]+ ", "").alias("message")
    )


@query("""SELECT app, count(*) AS lines, max(t) AS newest FROM $applog GROUP BY app""")
def read_project_records(spark, folder):
    # A log holds one hour of one application, as a rotated file would.
    rows = load(spark, folder, "applog").withColumn("hour", F.floor(F.col("t") / 3_600_000))
    stamp = F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    files = rows.groupBy(F.concat_ws("/", "app", F.col("hour").cast("string")).alias("log")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", F.concat_ws("  ", stamp, "message").alias("v")))), lambda x: x["v"]), "\n").alias("value")
    )
    out = readers.project_records(files)
    return out.groupBy(F.substring_index("log", "/", 1).alias("app")).agg(F.count("*").alias("lines"), F.max(F.unix_millis("ts")).alias("newest"))


@query("SELECT session, event_id AS seq, t, event_type AS type, k FROM $ev")
def read_event_lines(spark, folder):
    rows = load(spark, folder, "SELECT session, event_id AS seq, t, event_type AS type, k FROM $ev")
    out = readers.event_rows(writers.event_lines(rows))
    return out.select("session", "seq", "t", "type", F.variant_get("payload", "$.k", "int").alias("k"))


def bundles(spark, folder, form):
    """Ten documents in one text."""
    docs = load(spark, folder, "SELECT CAST(doc_id AS STRING) AS name, doc_id DIV 10 AS bundle, doc_id, text FROM $documents")
    if form == "header":
        part = F.concat(F.lit("FILE: "), "name", F.lit("\n====\n"), "text", F.lit("\n====\n"))
    else:
        part = F.concat(F.lit("-~{File: "), "name", F.lit("}~-\n"), "text", F.lit("\n-~{END}~-\n"))
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", part.alias("p"))))
    return docs.groupBy("bundle").agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "").alias("value"))


@query("SELECT doc_id // 10 AS bundle, CAST(doc_id AS STRING) AS path, text AS content FROM $documents")
def read_bundles(spark, folder):
    return readers.unbundle(bundles(spark, folder, "header"), "header", "====")


@query("SELECT doc_id // 10 AS bundle, CAST(doc_id AS STRING) AS path, replace(ltrim(text, chr(10)), chr(10), chr(13) || chr(10)) AS content FROM $documents")
def read_marked_bundles(spark, folder):
    return readers.unbundle(bundles(spark, folder, "marked"), "marked")
