"""Streams over the same rows give what the batch jobs give."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import events
from textloom.sources import readers, writers
from textloom.streaming import jobs

SENTINEL = 10_000_000


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Events in three files by time, with one far in the future at the end to push the watermark on."""
    random.seed(11)
    data, t = [], {s: 0 for s in "abc"}
    for i in range(300):
        s = random.choice("aaab" + "c")
        t[s] = max(t[s], i * 40) + random.choice([20, 100, 700, 1700, 2500])
        kind = random.choice(["dom", "dom", "request", "response", "failed"])
        data.append((s, t[s], i, kind, random.choice("xxy"), "{}"))
    schema = "session STRING, ms BIGINT, event_id BIGINT, kind STRING, verb STRING, args STRING"
    root = tmp_path_factory.mktemp("events")
    data.sort(key=lambda r: (r[1], r[2]))
    parts = [data[:100], data[100:200], data[200:], *[[("z", SENTINEL + n, 9000 + n, k, "q", "{}") for k in ("request", "response")] for n in (0, 1)]]
    for n, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis("ms")).coalesce(1)
        df.write.mode("append").parquet(str(root / f"part={n}"))
    batch = spark.read.parquet(str(root)).where("session <> 'z'").drop("part").withColumn("t", F.col("ms"))
    return str(root), batch


def stream(spark, rows):
    root, batch = rows
    schema = spark.read.parquet(root).drop("part").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(root)


def drain(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return [r for r in df.sparkSession.table(name).collect() if "session" not in r or r["session"] != "z"]


def test_watch_and_counts(spark, rows, tmp_path):
    got = drain(jobs.watch_regex(stream(spark, rows), "^(req|resp)", "kind"), "watch", tmp_path / "w")
    assert len(got) == rows[1].where("kind like 're%'").count()
    counts = drain(jobs.event_counts(stream(spark, rows).withColumn("type", F.col("kind")), "1 second", late="1 second"), "counts", tmp_path / "n")
    want = rows[1].groupBy(F.floor(F.col("ms") / 1000).alias("w"), "kind").count().collect()
    assert sorted((r["start"].timestamp(), r["type"], r["n"]) for r in counts) == sorted((float(r["w"]), r["kind"], r["count"]) for r in want)


def test_quiet_windows(spark, rows, tmp_path):
    got = drain(jobs.quiet_windows(stream(spark, rows), "500 milliseconds", "1 second"), "quiet", tmp_path)
    want = events.settle_windows(rows[1].withColumn("kind", F.lit("dom"))).collect()
    ms = lambda d: round(d.timestamp() * 1000)
    assert sorted((r["session"], ms(r["started"]), ms(r["settled"]), r["events"]) for r in got) == sorted((r["session"], r["started"], r["settled"], r["events"]) for r in want)


def test_settle_stream(spark, rows, tmp_path):
    got = drain(jobs.settle_stream(stream(spark, rows), late="1 second"), "settle", tmp_path)
    want = events.settle_windows(rows[1]).collect()
    shape = lambda rs: sorted((r["session"], r["started"], r["last"], r["events"], r["mutations"], r["timed_out"]) for r in rs)
    # A stretch with requests still open at the end never settles.
    assert set(shape(got)) <= set(shape(want)) and len(want) - len(got) <= 3


def test_open_requests_end_at_the_cap(spark, tmp_path):
    """A request without an end: the stretch is closed by the cap, is told apart, and leaves no state."""
    root = tmp_path / "in"
    for n, (s, ms, kind) in enumerate([("a", 1000, "request"), ("b", 1000, "dom"), ("z", SENTINEL, "dom"), ("z", SENTINEL + 1, "dom")]):
        df = spark.createDataFrame([(s, ms, n, kind)], "session STRING, ms BIGINT, event_id BIGINT, kind STRING").withColumn("ts", F.timestamp_millis("ms"))
        df.coalesce(1).write.parquet(str(root / f"part={n}"))
    schema = spark.read.parquet(str(root)).drop("part").schema
    df = jobs.settle_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(root)), late="1 second")
    q = df.writeStream.format("memory").queryName("capped").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert sorted((r["session"], r["ended_by"]) for r in spark.table("capped").collect() if r["session"] != "z") == [("a", "cap"), ("b", "quiet")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


def test_stall_alerts(spark, rows, tmp_path):
    got = drain(jobs.stall_alerts(stream(spark, rows), late="1 second"), "stalls", tmp_path)
    want = {(r["session"], r["t"] - r["gap_ms"]) for r in events.stall_gaps(rows[1], ["session"]).collect()}
    last = {(r["session"], r["m"]) for r in rows[1].groupBy("session").agg(F.max("t").alias("m")).collect()}
    assert {(r["session"], r["silent_since"]) for r in got} == want | last


def test_loop_alerts(spark, rows, tmp_path):
    got = drain(jobs.loop_alerts(stream(spark, rows), late="1 second"), "loops", tmp_path)
    want = events.detect_loops(rows[1]).where("looped").collect()
    assert sorted((r["session"], r["at"], r["repeat"]) for r in got) == sorted((r["session"], r["event_id"], r["repeat"]) for r in want)


def test_lifecycle_stream(spark, rows, tmp_path):
    shaped = stream(spark, rows).select(
        "session", "ts", F.concat(F.lit("r"), (F.col("event_id") % 40).cast("string")).alias("request_id"), F.lit("u").alias("url"), F.lit("GET").alias("method"), F.lit(None).cast("string").alias("error"),
        F.when(F.col("kind") == "request", "sent").when(F.col("kind") == "failed", "failed").when(F.col("kind") == "response", "finished").otherwise("other").alias("event"),
    )
    got = drain(jobs.request_lifecycle_stream(shaped, "5 seconds", "1 second"), "life", tmp_path)
    b = rows[1].withColumn("rid", F.col("event_id") % 40)
    sent = b.where("kind = 'request'").select("session", "rid", F.col("ms").alias("a"))
    ended = b.where("kind in ('failed', 'response')").select("session", "rid", F.col("ms").alias("z"))
    want = sent.join(ended, (sent["session"] == ended["session"]) & (sent["rid"] == ended["rid"]) & (F.col("z") >= F.col("a")) & (F.col("z") <= F.col("a") + 5000), "left")
    ms = lambda d: d and round(d.timestamp() * 1000)
    found = sorted((r["request_id"], ms(r["sent_at"]), ms(r["ended_at"]) or 0) for r in got if r["session"] != "z")
    assert found == sorted((f"r{r['rid']}", r["a"], r["z"] or 0) for r in want.select(sent["rid"], "a", "z").collect())


def test_ring_buffer_stream(spark, rows, tmp_path):
    shaped = stream(spark, rows)
    q = jobs.ring_buffer_stream(shaped, str(tmp_path / "c"), n=7)
    assert q.awaitTermination(300)
    table = jobs.ring_buffer_table(spark, str(tmp_path / "c"), shaped.schema).where("session <> 'z'")
    want = events.ring_buffer(rows[1], 7).select(*shaped.columns)
    assert sorted(map(str, table.collect())) == sorted(map(str, want.collect()))


def test_buffers_do_not_grow_with_batches(spark, tmp_path):
    """Twelve batches over two sessions and one without a name: the state holds the last five rows of each, no more."""
    root = tmp_path / "in"
    for n in range(12):
        df = spark.range(n * 9, n * 9 + 9).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("session"), F.timestamp_millis(F.floor(F.col("id") / 20)).alias("ts"), F.col("id").alias("event_id"))
        df.coalesce(1).write.parquet(str(root / f"part={n}"))
    schema = "session STRING, ts TIMESTAMP, event_id BIGINT"
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(root))
    q = jobs.ring_buffer_stream(read, str(tmp_path / "c"), n=5)
    assert q.awaitTermination(300)
    got = jobs.ring_buffer_table(spark, str(tmp_path / "c"), schema).collect()
    want = {s: [i for i in range(108) if ("a", "b", None)[i % 3] == s][-5:] for s in ("a", "b", None)}
    assert sorted((str(r["session"]), r["event_id"]) for r in got) == sorted((str(s), i) for s, ids in want.items() for i in ids)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6  # a list and its length for each session


def test_decisions_are_looked_up_by_key(spark, tmp_path):
    """Ten batches that say the same again write each decision once."""
    root = tmp_path / "in"
    for n in range(10):
        rows = [("s", f"v{k}", "mask" if n == 0 and k == 0 else f"later{n}", n) for k in range(n + 1)] + [(None, None, f"x{n}", n)]
        spark.createDataFrame(rows, "source STRING, norm_value STRING, decision STRING, n INT").withColumn("ts", F.timestamp_seconds("n")).coalesce(1).write.parquet(str(root / f"part={n}"))
    read = spark.readStream.schema("source STRING, norm_value STRING, decision STRING, n INT, ts TIMESTAMP").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(root))
    q = jobs.decision_memory(read, str(tmp_path / "out"), str(tmp_path / "c"))
    assert q.awaitTermination(300)
    got = sorted(map(str, (tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("source", "norm_value", "decision").collect())))
    want = [("s", "v0", "mask"), *[("s", f"v{k}", f"later{k}") for k in range(1, 10)], (None, None, "x0")]
    assert got == sorted(map(str, want))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 11


def test_mask_stream_and_decisions(spark, tmp_path):
    root = tmp_path / "docs"
    for n, (i, text) in enumerate([(1, "zip 12345"), (2, "mail a@x.org"), (3, "Okonkwo was here")]):
        spark.createDataFrame([(i, "p", text)], "doc_id BIGINT, source STRING, text STRING").coalesce(1).write.parquet(str(root / str(n)))
    docs = spark.readStream.schema("doc_id BIGINT, source STRING, text STRING").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(root))
    said = tmp_path / "said"
    for n, (v, d) in enumerate([("12345", "mask"), ("12345", "allow")]):
        spark.createDataFrame([("*", v, d, n)], "source STRING, norm_value STRING, decision STRING, n INT").withColumn("ts", F.timestamp_seconds("n")).coalesce(1).write.parquet(str(said / str(n)))
    told = spark.readStream.schema("source STRING, norm_value STRING, decision STRING, n INT, ts TIMESTAMP").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(said))
    assert jobs.decision_memory(told, str(tmp_path / "known"), str(tmp_path / "kc")).awaitTermination(300)
    decisions = lambda: spark.read.parquet(str(tmp_path / "known")).select("source", "norm_value", "decision")
    assert [tuple(r) for r in decisions().collect()] == [("*", "12345", "mask")]
    store = lambda: spark.createDataFrame([("f", "m", "name", "Okonkwo")], "family STRING, member STRING, path STRING, value STRING")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    assert jobs.mask_stream(docs, good, bad, str(tmp_path / "mc"), "key", decisions, store).awaitTermination(300)
    released = {r["doc_id"]: r["text"] for r in spark.read.parquet(good).collect()}
    assert released[3] == "@@@(f.m.name) was here" and released[1].startswith("zip ⟦wall:") and 2 not in released
    assert [r["doc_id"] for r in spark.read.parquet(bad).collect()] == [2]


def test_timeline_as_stream(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.range(5).select(F.lit("s").alias("session"), F.col("id").alias("seq"), F.col("id").alias("t"), F.lit("console").alias("type"))
    writers.write_event_timeline(df, out)
    copy = str(tmp_path / "copy")
    writers.write_event_timeline(readers.stream_event_timeline(spark, out).drop("payload"), copy, str(tmp_path / "c")).awaitTermination(300)
    assert sorted(r["seq"] for r in readers.read_event_timeline(spark, copy).collect()) == [0, 1, 2, 3, 4]
