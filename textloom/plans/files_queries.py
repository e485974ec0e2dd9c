"""Queries that write the given tables in a file format, read them back, and run streams over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import events, requests, shapes
from textloom.plans.catalog import query
from textloom.plans.events_queries import LIFE, network
from textloom.plans.identifiers_queries import SECRET, _policy_sql, decisions, forms
from textloom.plans.inputs import load
from textloom.session import job_folder
from textloom.sources import readers, writers
from textloom.streaming import jobs

_EVENT_FILES = "SELECT session, event_id AS seq, t, event_type AS type, k FROM $ev"


def written_events(spark, folder):
    path = job_folder(spark, "timeline")
    writers.write_event_timeline(load(spark, folder, _EVENT_FILES), path)
    return path


@query(_EVENT_FILES)
def event_timeline_files(spark, folder):
    back = readers.read_event_timeline(spark, written_events(spark, folder))
    return back.select("session", "seq", "t", "type", F.variant_get("payload", "$.k", "int").alias("k"))


@query("SELECT session, event_id AS seq, t, event_type AS type FROM $ev")
def event_timeline_stream(spark, folder):
    """The files as a stream, written once more, and read."""
    copy, state = job_folder(spark, "timeline"), job_folder(spark, "state")
    lines = readers.stream_event_timeline(spark, written_events(spark, folder)).drop("payload")
    writers.write_event_timeline(lines, copy, state).awaitTermination()
    return readers.read_event_timeline(spark, copy).drop("payload")


@query("""SELECT CAST(conv_id AS STRING) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM
          (SELECT conv_id, turn, role, regexp_replace(text, '[\\x00-\\x20]+$', '') AS text FROM $conversations) x WHERE text <> ''""")
def conversation_files(spark, folder):
    path = job_folder(spark, "conversations")
    writers.write_conversation_log(load(spark, folder, "SELECT CAST(conv_id AS STRING) AS conv_id, turn, role, text FROM $conversations"), path)
    files = spark.read.text(path, wholetext=True).select(F.col("conv_id").cast("string").alias("conv_id"), "value")
    return readers.conversation_records(files)


@query("""SELECT CAST(conv_id // 100 AS STRING) AS conv_id, row_number() OVER (PARTITION BY conv_id // 100 ORDER BY conv_id, turn) - 1 AS turn, role, text FROM
          (SELECT conv_id, turn, role, regexp_replace(text, '[\\x00-\\x20]+$', '') AS text FROM $conversations) x WHERE text <> ''""")
def conversation_log_splits(spark, folder):
    """Logs of a hundred conversations each, read in splits."""
    turns = load(spark, folder, "SELECT conv_id, turn, role, text FROM $conversations")
    lines = writers.conversation_lines(turns.withColumn("file", F.expr("conv_id DIV 100")), "file")
    listed = F.array_sort(F.collect_list(F.struct("conv_id", "turn", "value")))
    path = job_folder(spark, "logs")
    files = lines.groupBy("file").agg(F.array_join(F.transform(listed, lambda x: x["value"]), readers.RECORD_END).alias("value"))
    files.write.partitionBy("file").option("lineSep", readers.RECORD_END).text(path)
    return readers.read_conversation_log(spark, path, F.col("file"))


@query("""SELECT '/c/' || conv_id AS url, conv_id || '-' || turn AS node, lag(conv_id || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id,
          role, text AS content, 1700000000000 + turn * 1000 AS t FROM $conversations""")
def captured_request_files(spark, folder):
    """Each conversation as the body of one captured request, those of a hundred ids to a file."""
    turns = load(spark, folder, """SELECT conv_id, turn, CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS node, role, text,
        lag(CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM $conversations""")
    node = F.struct(F.col("node").alias("id"), F.col("parent").alias("parentId"), "role", F.col("text").alias("content"), (1_700_000_000 + F.col("turn")).alias("timestamp"))
    chats = turns.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("node", node))).alias("messages"))
    request = F.struct(
        F.concat(F.lit("/c/"), F.col("conv_id")).alias("url"),
        F.struct(F.lit("POST").alias("method"), F.struct(F.struct(F.struct("messages").alias("history")).alias("chat")).alias("body")).alias("options"),
    )
    path = job_folder(spark, "captured")
    files = chats.groupBy(F.expr("conv_id DIV 100").alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(request)), ","), F.lit("]")).alias("value"))
    files.write.partitionBy("file").text(path)
    nodes = requests.chat_nodes(readers.read_captured_requests(spark, path))
    return nodes.select("url", "node", "parent_id", "role", "content", "t")


@query("SELECT doc_id, source, octet_length(encode(text)) + 1 AS bytes, text || chr(10) AS text FROM $documents")
def corpus_files(spark, folder):
    """Every document as a text file of its own, named by its source and id."""
    path = job_folder(spark, "corpus")
    quoted = F.replace(F.url_encode("source"), F.lit("*"), F.lit("%2A"))
    name = F.concat_ws("/", F.concat(F.lit("source="), quoted), F.concat(F.lit("doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    writers.write_corpus(writers.corpus_names(load(spark, folder, "SELECT source, doc_id, text FROM $documents"), name), path)
    found = readers.read_corpus(spark, path)
    part = lambda name: F.when(F.contains("path", F.lit(f"/{name}=")), F.regexp_extract("path", f"/{name}=([^/]*)", 1))
    return found.where("NOT is_binary AND skipped IS NULL").select(part("doc_id").try_cast("bigint").alias("doc_id"), F.url_decode(part("source")).alias("source"), "bytes", "text")


@query(f"""SELECT session, url, CASE WHEN done IS NULL THEN 0 ELSE done - t0 END AS time, coalesce(status, 0) AS status FROM ({LIFE}) q""")
def har_files(spark, folder):
    path = job_folder(spark, "har")
    writers.export_har(events.request_lifecycle(network(spark, folder)), path)
    lines = spark.read.text(path).where("value LIKE '{\"started%' OR value LIKE ',{\"started%'").withColumn("value", F.ltrim("value", F.lit(",")))
    get = lambda p: F.get_json_object("value", p)
    return lines.select(F.col("session").cast("string").alias("session"), get("$.request.url").alias("url"), get("$.time").cast("bigint").alias("time"), get("$.response.status").cast("int").alias("status"))


@query(f"SELECT doc_id, text, CAST(pending = 0 AS INT) AS released FROM ({_policy_sql('pending')}) x")
def quarantine_files(spark, folder):
    """Written twice under one name: the second time replaces the first."""
    good, bad = job_folder(spark, "good"), job_folder(spark, "bad")
    masked = shapes.mask_by_policy(forms(spark, folder), decisions(spark, folder), SECRET)
    for _ in range(2):
        writers.write_quarantine(masked, good, bad, "a")
    rows = spark.read.parquet(good).unionByName(spark.read.parquet(bad))
    return rows.select("doc_id", "text", F.col("released").cast("int").alias("released"))


@query("SELECT doc_id // 10 AS bundle, CAST(doc_id AS STRING) AS path, text AS content FROM $documents")
def bundle_files(spark, folder):
    from textloom.plans.logs_queries import bundles

    path = job_folder(spark, "bundles")
    writers.unpack_bundle(readers.unbundle(bundles(spark, folder, "header"), "header", "===="), path)
    return spark.read.parquet(path).select(F.col("bundle").cast("bigint").alias("bundle"), "path", "content")


# ── streams over the event table ──────────────────────────────────────────────


def stream(spark, folder):
    """The event table as a stream, in one batch: the watermark moves when it is done."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select(F.col("user_id").cast("string").alias("session"), "event_id", "ts", F.col("event_type").alias("type"), "props")


def collected(spark, rows, label):
    """What a stream gives out until its source is used up."""
    path = job_folder(spark, label)
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", job_folder(spark, "state"))
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT event_id, props FROM $events WHERE regexp_matches(props, '[135]\\}$')")
def watch_regex_stream(spark, folder):
    return collected(spark, jobs.watch_regex(stream(spark, folder), r"[135]\}$", "props"), "watch").select("event_id", "props")


@query("""SELECT h AS hour, event_type AS type, count(*) AS n FROM (SELECT epoch_us(ts) // 3600000000 AS h, event_type FROM $events) e
          WHERE (h + 1) * 3600000 <= (SELECT max(epoch_us(ts) // 1000) FROM $events) - 600000 GROUP BY h, event_type""")
def event_counts_stream(spark, folder):
    """Windows that the watermark has closed."""
    counts = collected(spark, jobs.event_counts(stream(spark, folder), "1 hour"), "counts")
    return counts.select(F.floor(F.unix_seconds("start") / 3600).alias("hour"), "type", "n")


@query("""SELECT session, event_id FROM
          (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t DESC, event_id DESC) AS r FROM $ev) x WHERE r <= 20""")
def ring_buffer_stream(spark, folder):
    rows, state = stream(spark, folder), job_folder(spark, "state")
    jobs.ring_buffer_stream(rows, state, 20).awaitTermination()
    return jobs.ring_buffer_table(spark, state, rows.schema).select("session", "event_id")


@query("""SELECT session, gap_start AS silent_since FROM (SELECT session, t AS gap_start, lead(t) OVER (PARTITION BY session ORDER BY t, event_id) AS b FROM $ev) x WHERE b - gap_start > 36000000
          UNION ALL SELECT session, max(t) FROM $ev GROUP BY session HAVING max(t) + 36000001 <= (SELECT max(t) FROM $ev) - 10000""")
def stall_alerts_stream(spark, folder):
    """Silences whose end the stream has seen, and those that last when the watermark, ten seconds behind the last event, has passed the limit."""
    return collected(spark, jobs.stall_alerts(stream(spark, folder), limit_ms=36_000_000), "stalls").select("session", "silent_since")


_CALLS = """SELECT session, event_id, t, event_type AS call FROM $ev"""


@query(f"""SELECT session, event_id AS at, n - since + 1 AS repeat FROM (SELECT *, max(CASE WHEN changed THEN n END) OVER (PARTITION BY session ORDER BY n) AS since FROM
           (SELECT *, row_number() OVER w AS n, coalesce(call <> lag(call) OVER w, true) AS changed FROM ({_CALLS}) c WINDOW w AS (PARTITION BY session ORDER BY t, event_id)) x) y WHERE n - since + 1 >= 3""")
def loop_alerts_stream(spark, folder):
    """Calls that came three times in a row or more."""
    calls = stream(spark, folder).select("session", "event_id", "ts", F.col("type").alias("verb"), F.lit("").alias("args"))
    return collected(spark, jobs.loop_alerts(calls, forget_ms=1 << 50), "loops").select("session", "at", "repeat")


@query("""SELECT props AS norm_value, min_by(event_type, (t, event_type)) AS decision FROM $ev GROUP BY props""")
def decision_memory_stream(spark, folder):
    """The first decision about every value."""
    told = stream(spark, folder).select(F.lit("*").alias("source"), F.col("props").alias("norm_value"), F.col("type").alias("decision"), "ts")
    out = job_folder(spark, "decisions")
    jobs.decision_memory(told, out, job_folder(spark, "state")).awaitTermination()
    return spark.read.schema("source STRING, norm_value STRING, decision STRING").parquet(out).select("norm_value", "decision")
