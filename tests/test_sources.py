"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import corpus, requests, tasks
from textloom.sources import readers, writers


def write(folder, **files):
    for name, content in files.items():
        path = folder / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def test_value_store(spark, tmp_path):
    smiths = {
        "label": "x",
        "family": {"deers_family_id": 20240001, "ok": True, "none": None},
        "members": {"sponsor": {"first_name": " Ann ", "address": {"zip": "12345"}, "tags": ["a", {"b": 1.5}], "weird.key": "v"}, "odd": 7},
    }
    root = write(tmp_path / "s", **{"Smiths.JSON": json.dumps(smiths, indent=1), "bad stem.json": "{}", "notes.txt": "x", "list.json": '{"family": [], "members": 3}'})
    got = {(r["family"], r["member"], r["path"], r["value"]) for r in readers.read_value_store(spark, root).collect()}
    assert got == {
        ("smiths", None, "deers_family_id", "20240001"), ("smiths", "sponsor", "first_name", " Ann "), ("smiths", "sponsor", "address.zip", "12345"),
        ("smiths", "sponsor", "tags.0", "a"), ("smiths", "sponsor", "tags.1.b", "1.5"), ("smiths", "sponsor", "weird.key", "v"),
    }
    assert readers.read_value_store(spark, str(tmp_path / "absent")).count() == 0


@pytest.mark.parametrize("content", ['{"family": ', '{"family": {"id": 9007199254740993}}'])
def test_value_store_fails_closed(spark, tmp_path, content):
    root = write(tmp_path / "s", **{"a.json": content})
    with pytest.raises(Exception):
        readers.read_value_store(spark, root).collect()


def test_conversation_files(spark, tmp_path):
    u, r = "\x1e", "\x1f"
    root = write(tmp_path / "c", a=f"user{u} hi {r}assistant{u}x{u}y{r}user{u}{r}assistant{u}done{u}{u}{r}", b="", c=" \n")
    got = {(x["conv_id"], x["turn"], x["role"], x["text"]) for x in readers.read_conversation_log(spark, root).collect()}
    # Spark does not open files without a byte.
    assert got == {("a", 0, "user", " hi"), ("a", 1, "assistant", "done"), ("c", 0, "assistant", readers.GREETING)}


def test_large_conversations_are_read_in_splits(spark, tmp_path):
    """A file of many splits, whose borders fall anywhere, also within characters of several bytes: the same rows as from one string."""
    u, r = "\x1e", "\x1f"
    body = r.join(f"{'user' if i % 2 else 'assistant'}{u}turn {i} {'äß漢' * (i % 17)}\nline" if i % 11 else f"broken {i}" for i in range(3000))
    root = write(tmp_path / "c", big=body, small=f"user{u}x{r}")
    want = readers.conversation_records(spark.read.text(root, wholetext=True).select(readers.file_name().alias("conv_id"), "value"))
    want = sorted(map(tuple, want.collect()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "3001b")
        assert readers.file_records(spark, root, r).rdd.getNumPartitions() > 30
        for n in (100, 10**6):
            assert sorted(map(tuple, readers.read_conversation_log(spark, root, rows_per_slice=n).collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(want) == 3000 - 273 + 1


def test_conversation_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([("k", i, "user", f"line {i}\nmore") for i in range(5)], "conv_id STRING, turn BIGINT, role STRING, text STRING")
    writers.write_conversation_log(turns, str(tmp_path / "out"))
    texts = spark.read.text(str(tmp_path / "out"), wholetext=True).select("conv_id", "value")
    back = readers.conversation_records(texts).orderBy("turn").collect()
    assert [(r["turn"], r["text"]) for r in back] == [(i, f"line {i}\nmore") for i in range(5)]
    with pytest.raises(Exception):
        writers.conversation_lines(turns.withColumn("text", F.lit("a\x1eb"))).collect()


def test_event_timeline_round_trip(spark, tmp_path):
    out = str(tmp_path / "t")
    events = spark.createDataFrame([("s", i, 1000 + i, "console", f"m{i}") for i in range(4)], "session STRING, seq BIGINT, t BIGINT, type STRING, text STRING")
    writers.write_event_timeline(events.where("seq < 2"), out)
    writers.write_event_timeline(events.where("seq >= 2"), out)
    (tmp_path / "t" / "bad.txt").write_text("{not json\n")
    back = readers.read_event_timeline(spark, out)
    assert sorted(r["seq"] for r in back.collect()) == [0, 1, 2, 3]
    assert {r[0] for r in back.select(F.variant_get("payload", "$.text", "string")).collect()} == {"m0", "m1", "m2", "m3"}


def test_logs(spark, tmp_path):
    root = write(tmp_path / "d", log="[2024-05-01 10:00:00.123] hello [x]\nnoise\n")
    assert [(str(r["ts"]), r["message"]) for r in readers.read_debug_log(spark, root).collect()] == [("2024-05-01 10:00:00.123000", "hello [x]")]
    root = write(tmp_path / "p", log="2024-05-01T10:00:00.000Z  first\n2024-05-01T10:00:01.000Z  second\n")
    assert [r["message"] for r in readers.read_project_log(spark, root).orderBy("line").collect()] == ["first", "second"]
    assert [r["message"] for r in readers.read_project_log(spark, root, 33).collect()] == ["second"]


def test_task_store(spark, tmp_path):
    task = {"id": "T-1", "title": "t", "goal": "", "parentId": None, "childIds": [], "started": 1, "ended": None, "tier": 1, "summary": None,
            "messages": [{"kind": "tool-result", "role": "user", "content": "c", "toolName": "grep", "toolArgs": {"a": 1}, "bytes": 1}]}
    state = {"nextId": 3, "currentId": "T-1", "rootId": "T-1", "allTaskIds": ["T-1", "T-2"]}
    root = write(tmp_path / "w", **{"p1__T-1.json": json.dumps(task), "p1__T-2.json": "{broken", "p1__T-9.json": json.dumps(task | {"id": "T-9"}), "p1__state.json": json.dumps(state)})
    t, m = readers.read_task_store(spark, root)
    assert [(r["project"], r["id"], r["is_current"], r["position"]) for r in t.collect()] == [("p1", "T-1", True, 0)]
    assert [(r["task_id"], r["pos"], r["tool_name"]) for r in m.collect()] == [("T-1", 0, "grep")]


def test_captured_requests(spark, tmp_path):
    node = lambda i, p, t: {"id": i, "parentId": p, "childrenIds": [], "role": "user", "content": "${message}", "timestamp": t, "models": ["m"]}
    body = {"chat": {"history": {"messages": {"a": node("a", None, 1756572926), "b": node("b", "a", 1756572926979), "c": node("c", "gone", 5)}, "currentId": "b"}}}
    data = [{"url": "/api/v1/chats/new", "options": {"method": "POST", "headers": {"h": "v"}, "body": body}, "timestamp": 9, "isNewChat": True}]
    root = write(tmp_path / "r", **{"x.json": json.dumps(data)})
    nodes = requests.chat_nodes(readers.read_captured_requests(spark, root))
    assert {(r["node"], r["parent_id"], r["t"]) for r in nodes.collect()} == {("a", None, 1756572926000), ("b", "a", 1756572926979), ("c", "gone", 5000)}
    tree = requests.thread_tree(nodes.select(F.lit("x").alias("tree"), "node", "parent_id"))
    assert {(r["node"], r["root"], r["depth"]) for r in tree.collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "c", 0)}


def test_captured_files_are_bounded(spark, tmp_path, monkeypatch):
    """The number of conversations in a file does not grow with the table."""
    from textloom.plans import files_queries

    spark.range(2500).selectExpr("id AS conv_id", "0 AS turn", "'user' AS role", "'t' AS text").write.parquet(str(tmp_path / "conversations.parquet"))
    paths, read = [], readers.read_captured_requests
    monkeypatch.setattr(readers, "read_captured_requests", lambda s, path: paths.append(path) or read(s, path))
    assert files_queries.captured_request_files(spark, str(tmp_path)).count() == 2500
    counts = [r["value"].count('"url"') for r in spark.read.text(paths[0], wholetext=True).collect()]
    assert sum(counts) == 2500 and max(counts) <= 100


def test_long_thread_and_cycle(spark):
    rows = [("t", i, i - 1 if i else None) for i in range(150)] + [("u", 1, 2), ("u", 2, 1)]
    df = spark.createDataFrame(rows, "tree STRING, node BIGINT, parent_id BIGINT")
    got = {(r["tree"], r["node"]): (r["root"], r["depth"]) for r in requests.thread_tree(df, 256).collect()}
    assert all(got["t", i] == (0, i) for i in range(150))
    assert got["u", 1][0] is None


def test_sse(spark, tmp_path):
    text = ': hi\ndata: {"choices":[{"delta":{"content":"a"}}]}\r\n\ndata: {bad\ndata: {"usage":{"total_tokens":5}}\ndata: {"usage":{"total_tokens":9}}\ndata: {"choices":[{"delta":{"content":"b"},"finish_reason":"stop"}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"late"}}]}\n'
    root = write(tmp_path / "e", s1=text)
    chunks = readers.chunk_fields(readers.read_sse_chunks(spark, root), ["stream_id"])
    row = tasks.assemble_stream(chunks, ["stream_id"]).first()
    assert (row["text"], row["total_tokens"], row["finish_reason"]) == ("ab", 5, "stop")


def test_stream_response(spark, tmp_path):
    reply = lambda t, **k: {"streamAssistResponse": {"answer": {"replies": [{"groundedContent": {"content": {"text": t, **k}}}]}}}
    root = write(tmp_path / "g", a=')]}"\n' + json.dumps([reply("x\\n", thought=False), reply("no", thought=True), {"other": 1}, reply("y ")]), b=json.dumps(reply("z")))
    got = {r[0] for r in readers.read_stream_response(spark, root).select(tx.assistant_reply_text(F.col("chunks"))).collect()}
    assert got == {"x\ny", "z"}


HEADER = "x\nFILE: a.txt\n====\none\n  two\n====\nFILE: empty\n====\n====\nFILE: a.txt\n  ====\nlast\nFILE: b.txt\n====\nopen\n"
MARKED = "skip\n-~{File: d/a.txt}~-\n\n\none\r\n\ntwo\n-~{END}~-\n-~{File: n}~-\n-~{END}~-\n-~{File: lost}~-\nx"


def test_bundles(spark, tmp_path):
    root = write(tmp_path / "b", bundle=HEADER)
    got = {r["path"]: r["content"] for r in readers.read_bundle(spark, root, "header", "====").collect()}
    assert got == {"a.txt": "last", "b.txt": "open\n"}
    root = write(tmp_path / "m", bundle=MARKED)
    files = readers.read_bundle(spark, root, "marked")
    assert {r["path"]: r["content"] for r in files.collect()} == {"d/a.txt": "one\r\n\r\ntwo", "n": ""}
    writers.unpack_bundle(files, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2


def test_corpus(spark, tmp_path):
    root = write(tmp_path / "r", **{"src__a.py": "x = 1\ny = 2", "src__b.bin": b"\0\1", "c.txt": b"a\0b", "node_modules__m.js": "no", "README": "hi", "src__sub__d.md": "é"})
    got = {r["path"]: (r["bytes"], r["text"], r["is_binary"]) for r in readers.read_corpus(spark, root).collect()}
    assert got == {"src/a.py": (11, "x = 1\ny = 2", False), "c.txt": (3, None, True), "README": (2, "hi", False), "src/sub/d.md": (2, "é", False)}
    info = {r["path"]: r["lines"] for r in corpus.file_info(readers.read_corpus(spark, root)).collect()}
    assert info == {"src/a.py": 2, "c.txt": None, "README": 1, "src/sub/d.md": 1}


def test_network_artifacts(spark, tmp_path):
    meta = json.dumps({"url": "u", "method": "GET", "status": 200, "mimeType": "text/html"})
    root = write(tmp_path / "n", **{"r_1.meta.json": meta, "r_1.body.html": "<p>", "r_2.meta.json": meta})
    got = {(r["request"], r["status"], r["body"]) for r in readers.read_network_artifacts(spark, root).collect()}
    assert got == {("r_1", 200, "<p>"), ("r_2", 200, None)}
    assert spark.range(1).select(readers.safe_id(F.lit("a:1/b.c-d"))).first()[0] == "a_1_b.c-d"


def test_bundles_share_files(spark, tmp_path):
    """Many bundles do not make many files, and a bundle without a name stays one."""
    files = spark.range(400).selectExpr("nullif(id div 2, 7) AS bundle", "cast(id AS string) AS path", "'c' AS content").repartition(3, "bundle")
    writers.unpack_bundle(files, str(tmp_path / "u"))
    back = spark.read.parquet(str(tmp_path / "u"))
    assert back.count() == 400 and back.where("bundle IS NULL").count() == 2 and dict(back.dtypes)["bundle"] == "bigint"
    assert len(list((tmp_path / "u").rglob("*.parquet"))) <= 3


def test_corpus_written(spark, tmp_path):
    """Odd names and texts come back, and files are dealt to folders by their number, not to a folder each."""
    rows = [(f"source=a%2Fb/doc_id={i}", "" if i == 7 else f"text {i}\nüß ") for i in range(50)] + [("plain", None)]
    files = spark.createDataFrame(rows, "name string, text string")
    named = writers.corpus_names(files, F.col("name"), 10)
    root = str(tmp_path / "c")
    for _ in range(2):  # a task that is repeated replaces its files
        writers.write_corpus(named, root)
    got = {r["path"].split("/", 1)[1]: r["text"] for r in readers.read_corpus(spark, root).collect()}
    assert got == {name: (text or "") + "\n" for name, text in rows}
    assert len(list((tmp_path / "c").iterdir())) <= 6
    assert not [p for p in (tmp_path / "c").rglob("*") if p.name.startswith(".")]


def test_corpus_files_odd_names(spark, tmp_path):
    from textloom.plans import files_queries

    rows = [(1, "a/b", "x"), (2, "*", "y"), (3, "100%", "z\nz"), (4, "", ""), (5, None, "v"), (6, "a b+c", "w")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in files_queries.corpus_files(spark, str(tmp_path)).select("doc_id", "source", "text").collect())
    assert got == [(i, s, t + "\n") for i, s, t in rows]


def test_har(spark, tmp_path):
    df = spark.createDataFrame(
        [("s", "r1", "GET", "u", 1000, 1250, 200, 10, "text/html", {"a": "b"}), ("s", "r2", "GET", "v", 2000, None, None, None, None, None)],
        "session STRING, request_id STRING, method STRING, url STRING, t0 BIGINT, done BIGINT, status INT, size BIGINT, mime STRING, req_headers MAP<STRING, STRING>",
    )
    lines = [r["value"] for r in writers.har_lines(df).collect()]
    entries = json.loads("\n".join(lines))["log"]["entries"]
    assert [(e["time"], e["response"]["status"], e["startedDateTime"]) for e in entries] == [(250, 200, "1970-01-01T00:00:01.000Z"), (0, 0, "1970-01-01T00:00:02.000Z")]
    assert entries[0]["request"]["headers"] == [{"name": "a", "value": "b"}]
    writers.export_har(df, str(tmp_path / "h"))
    parts = sorted((tmp_path / "h" / "session=s").glob("part-*"))
    assert json.loads("".join(p.read_text() for p in parts))["log"]["version"] == "1.2"


def test_har_of_many_sessions(spark, tmp_path):
    """Folders as Spark reads them, whatever the sessions are called; written again, a document replaces the one before; nothing passes a commit."""
    names = ["a", "b/c", "d=e", "100%", "ü x", 'q"#\'*?:\\{[]^']
    kind = "session STRING, request_id STRING, method STRING, url STRING, t0 BIGINT, done BIGINT, status INT, size BIGINT, mime STRING"
    rows = [(n, f"r{i}", "GET", f"u{i}", 1000 + i, 1250, 200, 10, "text/html") for n in names for i in range(5)]
    path = str(tmp_path / "h")
    writers.export_har(spark.createDataFrame([("old", *r[1:]) for r in rows], kind), path)
    writers.export_har(spark.createDataFrame(rows, kind), path)
    back = spark.read.text(path).where("value LIKE '%startedDateTime%'").groupBy("session").count()
    assert {r["session"]: r["count"] for r in back.collect()} == {n: 5 for n in names}
    for folder in (tmp_path / "h").glob("session=*"):
        whole = json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
        assert [e["request"]["url"] for e in whole["log"]["entries"]] == [f"u{i}" for i in range(5)]
    assert not list((tmp_path / "h").rglob("_SUCCESS")) and not [p for p in (tmp_path / "h").rglob(".*")]


def test_quarantine(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False)], "doc_id BIGINT, released BOOLEAN")
    writers.write_quarantine(df, str(tmp_path / "a"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "a")).first()[0] == 1
    assert spark.read.parquet(str(tmp_path / "b")).first()[0] == 2


def test_quarantine_keeps_no_copy(spark, tmp_path):
    """Rows wait in compressed files that are gone afterwards, and a run may read what it replaces."""
    root, good, bad = tmp_path / "shared", str(tmp_path / "a"), str(tmp_path / "b")
    kept = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(root))
    try:
        rows = spark.range(20_000).selectExpr("id AS doc_id", "repeat('some text ', 40) AS text", "CASE WHEN id % 5 > 1 THEN true WHEN id % 5 = 1 THEN false END AS released")
        writers.write_quarantine(rows, good, bad, "x")
        again = spark.read.parquet(bad).drop("run").withColumn("released", F.col("doc_id") % 2 == 1)
        writers.write_quarantine(again, good, bad, "x")
        assert {r["released"] for r in spark.read.parquet(good).select("released").distinct().collect()} == {True}
        assert [spark.read.parquet(p).where("run = 'x'").count() for p in (good, bad)] == [2000, 2000]
        writers.write_quarantine(spark.read.parquet(bad).drop("run").where("released"), good, bad, "x")
        assert [spark.read.parquet(p).count() for p in (good, bad)] == [0, 0]
        assert not [p for p in root.rglob("*") if p.is_file()]
    finally:
        spark.sparkContext.setCheckpointDir(kept.rpartition("/")[0])


def test_corpus_of_small_files_is_read_in_few_tasks(spark, tmp_path, monkeypatch):
    """A task reads many small files. What is listed and read is what Spark lists and reads, in a folder of any name."""
    root = tmp_path / "a b%20ü#1"
    names = [f"{i}/{'é' if i % 2 else 'x y'}/doc={i}" for i in range(300)] + ["top.txt", "d.e/.hidden", "_no/a.txt", "_k=v/a.txt", ".git/a.txt", "n/node_modules/b.js", "n/a._COPYING_", "n/x.bin", "n/deep/er/y.PY"]
    for n, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"t\0" if n == 5 else f"text {n} é".encode() * (n % 3))
    key = lambda df: sorted(map(str, df.collect()))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        assert readers.read_corpus(spark, str(root)).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    got = {k: [key(readers.read_corpus(spark, p, *k)) for p in (str(root), f"{root}/")] for k in ((), (9, None), (None, 2))}
    monkeypatch.setattr(readers, "corpus_listing", lambda *a: None, raising=False)
    for k, rows in got.items():
        want = key(readers.read_corpus(spark, str(root), *k))
        assert rows == [want, want] and len(want) == 201
    monkeypatch.undo()
    monkeypatch.setattr(readers, "FILES_PER_TASK", 20, raising=False)
    monkeypatch.setattr(readers, "BYTES_HELD", 40, raising=False)
    assert key(readers.read_corpus(spark, str(root))) == got[()][0] and readers.read_corpus(spark, str(root)).rdd.getNumPartitions() >= 10
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_corpus(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert readers.read_corpus(spark, str(tmp_path / "empty")).count() == 0
