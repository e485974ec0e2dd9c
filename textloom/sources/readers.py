"""Readers for the file formats of stores, logs, captures, bundles and corpora."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import java_trim, js_trim
from textloom.operators.ordered import ROWS_PER_SLICE, ordered_scan, slices

# Separators of conversation files, corpus rules.
RECORD_END = "\x1f"
FIELD_END = "\x1e"
GREETING = "Hello! How can I help you today?"
IGNORED_FOLDERS = ("node_modules", ".git", "dist", ".agent", "coverage")
TEXT_SUFFIXES = (
    ".mjs", ".js", ".ts", ".tsx", ".jsx", ".json", ".md", ".txt", ".yml", ".yaml",
    ".sh", ".ps1", ".bat", ".cmd", ".py", ".go", ".rs", ".java", ".xml", ".html",
    ".css", ".scss", ".sql", ".toml", ".ini", ".env", ".gitignore", "",
)
SAMPLE_BYTES = 8192
#: Files and bytes that a task reads of a corpus, and bytes that it holds at a time.
FILES_PER_TASK, BYTES_PER_TASK, BYTES_HELD = 5000, 1 << 26, 1 << 23
MAX_SAFE_INTEGER = 2**53 - 1
STORE_DEPTH = 8
EVENT_SCHEMA = "session STRING, seq BIGINT, t BIGINT, type STRING, payload VARIANT"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def file_name() -> Column:
    return F.col("_metadata.file_name")


def file_path() -> Column:
    return F.col("_metadata.file_path")


# ── value store ───────────────────────────────────────────────────────────────


def read_value_store(spark: SparkSession, path: str) -> DataFrame:
    """(family, member, path, value, value_type) of every string and number in a folder with one JSON file per family.

    A missing folder is an empty store, a malformed file raises, and so does a number too large to be exact. Files whose
    name is not a clean label are skipped.
    """
    empty = spark.createDataFrame([], "family STRING, member STRING, path STRING, value STRING, value_type STRING")
    if not path_exists(spark, path):
        return empty
    raw = (
        spark.read.text(path, wholetext=True, pathGlobFilter="*.[jJ][sS][oO][nN]")
        .select(F.regexp_replace(F.lower(file_name()), r"\.json$", "").alias("family"), F.parse_json("value").alias("v"))
        .where(F.col("family").rlike("^[a-z0-9_-]+$"))
    )
    top = raw.select("family", F.explode(F.array(F.lit("family"), F.lit("members"))).alias("part"), "v")
    found = top.select(
        "family", "part",
        F.when(F.col("part") == "family", F.try_variant_get("v", "$.family", "variant")).otherwise(F.try_variant_get("v", "$.members", "variant")).alias("v"),
    )
    fam = found.where("part = 'family'").select("family", F.lit(None).cast("string").alias("member"), F.lit("").alias("path"), "v")
    fam = fam.where(F.schema_of_variant("v").startswith("OBJECT"))
    members = found.where("part = 'members'").where(F.schema_of_variant("v").startswith("OBJECT"))
    members = _children(members.select("family", "v")).select("family", F.col("key").alias("member"), F.lit("").alias("path"), F.col("value").alias("v"))
    level, leaves = fam.unionByName(members), empty
    # Nesting deeper than the limit fails, so no value is left out in silence.
    for depth in range(STORE_DEPTH):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = leaves.unionByName(_leaf_rows(level.where(~nested).where("path != ''")))
        level = _children(level.where(nested)).select(
            "family", "member",
            F.when(F.col("path") == "", F.coalesce("key", F.col("pos").cast("string"))).otherwise(F.concat_ws(".", "path", F.coalesce("key", F.col("pos").cast("string")))).alias("path"),
            F.col("value").alias("v"),
        )
    deep = level.select("family", "member", "path", F.raise_error(F.lit("values nested too deeply")).cast("string").alias("value"), F.lit("").alias("value_type"))
    return leaves.unionByName(deep)


def _children(df: DataFrame) -> DataFrame:
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))


def _leaf_rows(df: DataFrame) -> DataFrame:
    kind = F.schema_of_variant("v")
    number = F.try_variant_get("v", "$", "double")
    exact = F.try_variant_get("v", "$", "bigint").cast("string")
    unsafe = F.raise_error(F.concat(F.lit("number too large to be exact at "), F.col("path"))).cast("string")
    whole = number == F.floor(number)
    text = (
        F.when(kind == "STRING", F.try_variant_get("v", "$", "string"))
        .when(F.abs(number) > MAX_SAFE_INTEGER, unsafe)
        .when(whole, exact)
        .otherwise(F.try_variant_get("v", "$", "string"))
    )
    wanted = (kind == "STRING") | kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return df.where(wanted).select("family", "member", "path", text.alias("value"), F.when(kind == "STRING", "string").otherwise("number").alias("value_type"))


# ── conversation and other logs ───────────────────────────────────────────────


def conversation_records(texts: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from whole conversation files (conv_id, value).

    Records without exactly two fields are dropped; a file without records yields the greeting.
    """
    records = F.filter(F.transform(F.split("value", RECORD_END, -1), java_trim), lambda r: r != "")
    # Trailing empty fields do not count.
    fields = F.transform(records, lambda r: F.split(F.regexp_replace(r, FIELD_END + "+$", ""), FIELD_END, -1))
    kept = F.filter(fields, lambda f: F.size(f) == 2)
    greeting = F.array(F.array(F.lit("assistant"), F.lit(GREETING)))
    rows = F.when(F.size(kept) > 0, kept).otherwise(greeting)
    return texts.select("conv_id", F.posexplode(rows).alias("turn", "r")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("r")[0].alias("role"), F.col("r")[1].alias("text")
    )


def file_records(spark: SparkSession, path: str, separator: str, key: Column | None = None) -> DataFrame:
    """(file, block, place, value): the records of files, read in splits. (block, place) is their order within a file.

    Files are cut by bytes and a split reads on to the end of its last record, so one large file is read by all cores. ``key`` names
    the file, by its name if it is not given.
    """
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select((file_name() if key is None else key).cast("string").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")


def read_conversation_log(spark: SparkSession, path: str, key: Column | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(conv_id, turn, role, text) of conversation files, one conversation each, with the rules of ``conversation_records``.

    Records are read in splits and numbered in slices: a conversation of any size is many tasks.
    """
    bare = F.regexp_replace(java_trim(F.col("value")), FIELD_END + "+$", "")
    fields = file_records(spark, path, RECORD_END, key).select("file", "block", "place", F.split(bare, FIELD_END, -1).alias("r"))
    kept = fields.where(F.size("r") == 2)
    order = ["block", "place"]
    numbered = ordered_scan(kept, ["file"], order, slices(kept, ["file"], order, rows_per_slice), sums={"n": F.lit(1).cast("bigint")})
    turns = numbered.select(F.col("file").alias("conv_id"), (F.col("n") - 1).alias("turn"), F.col("r")[0].alias("role"), F.col("r")[1].alias("text"))
    # Only names are read here, no contents.
    names = spark.read.format("binaryFile").load(path).select((file_name() if key is None else key).cast("string").alias("conv_id")).distinct()
    bare_files = names.join(turns.select("conv_id").distinct(), "conv_id", "left_anti")
    return turns.unionByName(bare_files.select("conv_id", F.lit(0).cast("bigint").alias("turn"), F.lit("assistant").alias("role"), F.lit(GREETING).alias("text")))


def debug_records(lines: DataFrame) -> DataFrame:
    """(ts, message) from ``[yyyy-MM-dd HH:mm:ss.SSS] message`` lines (value); other lines are dropped."""
    pattern = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})\] (.*)$"
    hits = lines.where(F.col("value").rlike(pattern))
    return hits.select(
        F.to_timestamp(F.regexp_extract("value", pattern, 1), "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"),
        F.regexp_extract("value", pattern, 2).alias("message"),
    )


def read_debug_log(spark: SparkSession, path: str) -> DataFrame:
    return debug_records(spark.read.text(path))


def project_records(texts: DataFrame, tail_chars: int | None = None) -> DataFrame:
    """(log, line, ts, message) from whole ``<ISO time>  <message>`` logs (log, value).

    With ``tail_chars`` only whole lines among the last characters, counted from the first of these.
    """
    value = F.col("value")
    if tail_chars is not None:
        tail = F.expr(f"right(value, {int(tail_chars)})")
        starts_line = F.expr(f"substring(value, length(value) - {int(tail_chars)}, 1)") == "\n"
        value = F.when((F.length("value") <= tail_chars) | starts_line, tail).otherwise(F.regexp_replace(tail, r"^[^\n]*(\n|$)", ""))
    rows = texts.select("log", F.posexplode(F.split(value, "\n", -1)).alias("line", "row"))
    pattern = r"^(\S+)  (.*)$"
    hits = rows.where(F.col("row").rlike(pattern))
    return hits.select(
        "log", (F.col("line") + 1).alias("line"),
        F.try_to_timestamp(F.regexp_extract("row", pattern, 1)).alias("ts"), F.regexp_extract("row", pattern, 2).alias("message"),
    )


def read_project_log(spark: SparkSession, path: str, tail_chars: int | None = None) -> DataFrame:
    return project_records(spark.read.text(path, wholetext=True).select(file_path().alias("log"), "value"), tail_chars)


def event_rows(lines: DataFrame) -> DataFrame:
    """Event lines (value, JSON) as the common envelope with the whole line as VARIANT; malformed lines are dropped."""
    v = lines.select(F.try_parse_json("value").alias("payload")).where(F.col("payload").isNotNull())
    get = lambda name, kind: F.try_variant_get("payload", f"$.{name}", kind).alias(name)
    return v.select(get("session", "string"), get("seq", "bigint"), get("t", "bigint"), get("type", "string"), "payload")


def read_event_timeline(spark: SparkSession, path: str) -> DataFrame:
    return event_rows(spark.read.text(path))


def stream_event_timeline(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return event_rows(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


# ── task store ────────────────────────────────────────────────────────────────

TASK_SCHEMA = """id STRING, title STRING, goal STRING, parentId STRING, childIds ARRAY<STRING>, started BIGINT, ended BIGINT,
tier INT, summary STRING, messages ARRAY<STRUCT<kind: STRING, role: STRING, content: STRING, toolName: STRING,
toolArgs: VARIANT, toolStatus: STRING, bytes: BIGINT>>, _corrupt_record STRING"""
STATE_SCHEMA = "nextId BIGINT, currentId STRING, rootId STRING, allTaskIds ARRAY<STRING>"


def read_task_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tasks and messages of all projects under ``path``; the project is the folder a file lies in.

    Unreadable task files count as absent, and tasks the state file does not list are left out.
    """
    folder = F.regexp_extract(file_path(), r"([^/]+)/[^/]+$", 1).alias("project")
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", "T-*.json").schema(TASK_SCHEMA).json(path).select(folder, "*")
    state = reader.option("pathGlobFilter", "state.json").schema(STATE_SCHEMA).json(path).select(folder, "currentId", F.posexplode("allTaskIds").alias("position", "id"))
    good = rows.where("_corrupt_record IS NULL AND id IS NOT NULL")
    listed = good.join(state, ["project", "id"])
    tasks = listed.select(
        "project", "id", "title", "goal", F.col("parentId").alias("parent_id"), "started", "ended", "tier", "summary",
        "position", (F.col("id") == F.col("currentId")).alias("is_current"),
    )
    messages = listed.select("project", F.col("id").alias("task_id"), F.posexplode("messages").alias("pos", "m")).select(
        "project", "task_id", "pos", "m.kind", "m.role", "m.content", F.col("m.toolName").alias("tool_name"),
        F.col("m.toolArgs").alias("tool_args"), F.col("m.toolStatus").alias("tool_status"), "m.bytes",
    )
    return tasks, messages


# ── captured requests and streamed responses ──────────────────────────────────

_NODE = "STRUCT<id: STRING, parentId: STRING, childrenIds: ARRAY<STRING>, role: STRING, content: STRING, timestamp: BIGINT, models: ARRAY<STRING>, model: STRING>"
REQUEST_SCHEMA = f"""url STRING, options STRUCT<method: STRING, headers: MAP<STRING, STRING>, body: STRUCT<
chat: STRUCT<id: STRING, title: STRING, models: ARRAY<STRING>, history: STRUCT<messages: MAP<STRING, {_NODE}>, currentId: STRING>, timestamp: BIGINT>,
model: STRING, messages: ARRAY<STRUCT<role: STRING, content: STRING>>, session_id: STRING, chat_id: STRING, id: STRING>>,
timestamp BIGINT, isNewChat BOOLEAN, isTemplate BOOLEAN"""


def read_captured_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(REQUEST_SCHEMA).json(path)


def sse_chunks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Parsed ``data:`` lines (keys, pos, line) up to the end mark; comments, blanks and malformed JSON are dropped."""
    line = F.regexp_replace("line", "\r$", "")
    data = js_trim(F.substr(line, F.lit(6), F.length(line)))
    rows = lines.select(*keys, "pos", F.when(line.startswith("data:"), data).alias("data")).where(F.col("data").isNotNull())
    ends = rows.where(F.col("data") == "[DONE]").groupBy(*keys).agg(F.min("pos").alias("_end"))
    open_rows = rows.join(ends, keys, "left").where(F.col("_end").isNull() | (F.col("pos") < F.col("_end")))
    return open_rows.select(*keys, "pos", F.try_parse_json("data").alias("chunk")).where(F.col("chunk").isNotNull())


def read_sse_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of streamed responses, one file per stream."""
    text = spark.read.text(path, wholetext=True).select(file_path().alias("stream_id"), "value")
    return sse_chunks(text.select("stream_id", F.posexplode(F.split("value", "\n", -1)).alias("pos", "line")), ["stream_id"])


def chunk_fields(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Delta text, finish reason and token usage of each chunk."""
    get = lambda path, kind: F.try_variant_get("chunk", path, kind)
    return chunks.select(
        *keys, "pos",
        get("$.choices[0].delta.content", "string").alias("delta"),
        get("$.choices[0].finish_reason", "string").alias("finish_reason"),
        get("$.usage.total_tokens", "bigint").alias("total_tokens"),
    )


def response_parts(texts: DataFrame, text: str = "value") -> DataFrame:
    """Add ``chunks`` (ARRAY<VARIANT>): the response without its anti-hijacking prefix, a single object as a list of one."""
    body = F.when(F.col(text).startswith(')]}"'), F.substr(F.col(text), F.lit(6), F.length(text))).otherwise(F.col(text))
    v = F.parse_json(body)
    parts = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    return texts.withColumn("chunks", parts)


def read_stream_response(spark: SparkSession, path: str) -> DataFrame:
    return response_parts(spark.read.text(path, wholetext=True).select(file_path().alias("response"), "value")).drop("value")


# ── bundles ───────────────────────────────────────────────────────────────────


def unbundle(texts: DataFrame, form: str = "header", delimiter: str = "=" * 80) -> DataFrame:
    """(bundle, path, content) of the files packed into each text (bundle, value).

    ``header``  ``FILE: name`` starts a file at any place, a delimiter line switches its content on and off, empty files
                are dropped
    ``marked``  ``-~{File: name}~-`` to ``-~{END}~-``; leading blank lines vanish, line ends become CR LF, an
                unterminated file is dropped
    Of two files with one name the last counts. The windows run over the lines of one bundle, which is one string.
    """
    ends = "\n" if form == "header" else "\r?\n"
    rows = texts.select("bundle", F.posexplode(F.split("value", ends, -1)).alias("n", "line"))
    here = Window.partitionBy("bundle").orderBy("n")
    if form == "header":
        bare = js_trim(F.col("line"))
        head = bare.startswith("FILE: ")
        rows = rows.select("*", F.when(head, F.col("n")).alias("_h"), F.when(head, js_trim(F.substr(bare, F.lit(7), F.length(bare)))).alias("_p"), (bare == delimiter).alias("_d"))
        rows = rows.withColumn("file", F.last("_h", True).over(here)).withColumn("path", F.last("_p", True).over(here))
        inside = Window.partitionBy("bundle", "file").orderBy("n")
        rows = rows.withColumn("_on", F.sum(F.col("_d").cast("int")).over(inside) % 2 == 1)
        rows = rows.where(F.col("file").isNotNull() & F.col("_on") & ~F.col("_d") & F.col("_h").isNull())
        glue = "\n"
    else:
        pattern = r"(?i)^-~\{File: (.+)\}~-$"
        head, end = F.col("line").rlike(pattern), F.lower("line") == "-~{end}~-"
        rows = rows.select("*", F.when(head | end, F.col("n")).alias("_h"), F.when(head, F.regexp_extract("line", pattern, 1)).when(end, F.lit("")).alias("_p"), end.alias("_e"))
        rows = rows.withColumn("file", F.last("_h", True).over(here)).withColumn("path", F.last("_p", True).over(here))
        # The part after a head is complete when the next mark is an end.
        after = Window.partitionBy("bundle").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
        rows = rows.withColumn("_closed", F.first(F.when(F.col("_h").isNotNull(), F.col("_e")), True).over(after))
        start = Window.partitionBy("bundle", "file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        heads = rows.where(F.col("_h").isNotNull() & ~F.col("_e") & F.coalesce("_closed", F.lit(False))).select("bundle", "file", "path")
        body = rows.where(F.col("_h").isNull()).withColumn("_begun", F.max(F.col("line") != "").over(start)).where("_begun").select("bundle", "file", "n", "line")
        rows = heads.join(body, ["bundle", "file"], "left")
        glue = "\r\n"
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "line")))), lambda x: x["line"])
    files = rows.groupBy("bundle", "path", "file").agg(F.array_join(parts, glue).alias("content"))
    return files.groupBy("bundle", "path").agg(F.max_by("content", "file").alias("content"))


def read_bundle(spark: SparkSession, path: str, form: str = "header", delimiter: str = "=" * 80) -> DataFrame:
    return unbundle(spark.read.text(path, wholetext=True).select(file_path().alias("bundle"), "value"), form, delimiter)


# ── corpus and network artefacts ──────────────────────────────────────────────


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, given as a path or a URI, and the path there."""
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def hidden(name: str) -> bool:
    """Whether Spark passes over files and folders of this name."""
    return (name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name) and not name.startswith(("_metadata", "_common_metadata"))


def _listed(system: fs.FileSystem, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
    """Folders, and files with their bytes, that lie in a folder and are not hidden. Empty files have no rows in Spark's readers either."""
    found = [i for i in system.get_file_info(fs.FileSelector(folder)) if not hidden(i.base_name)]
    return [i.path for i in found if i.type == fs.FileType.Directory], [(i.path, i.size) for i in found if i.type == fs.FileType.File and i.size]


def corpus_listing(spark: SparkSession, root: str) -> tuple[str, DataFrame] | None:
    """The folder as a URI, and (path, length) of the files below it. None for a folder that pyarrow does not open, and for a pattern.

    The driver lists the upper folders until all cores have some to list, and holds no list of the files below those.
    """
    if re.search(r"[*?{\[\\]", root):
        return None
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        whole = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
        uri = quote(whole, safe="/:@,;=+&!$'()~")
        system, base = open_folder(uri)
        if system.get_file_info(base).type != fs.FileType.Directory:
            return None
    except (Py4JJavaError, OSError, ValueError, NotImplementedError):
        return None
    wanted, folders, files = 8 * spark.sparkContext.defaultParallelism, [base], []
    while folders and len(folders) < wanted:
        listed = [_listed(system, f) for f in folders]
        folders = [f for inner, _ in listed for f in inner]
        files += [f for _, here in listed for f in here]
    kind, cut = pa.schema([("path", pa.string()), ("length", pa.int64())]), len(base.rstrip("/")) + 1

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(uri)
        for batch in batches:
            open_folders = batch.column("folder").to_pylist()
            while open_folders:
                inner, here = _listed(system, open_folders.pop())
                open_folders += inner
                if here:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([p[cut:] for p, _ in here], [n for _, n in here]), kind)], schema=kind)

    # The driver's list is of folders, not of files, unless all files lie in the upper ones.
    upper = spark.createDataFrame(pa.Table.from_arrays([pa.array([p[cut:] for p, _ in files], pa.string()), pa.array([n for _, n in files], pa.int64())], schema=kind))
    lower = spark.createDataFrame(pa.table({"folder": pa.array(folders, pa.string())})).repartition(max(1, min(len(folders), wanted)))
    return uri, upper.unionByName(lower.mapInArrow(below, "path string, length long"))


def read_files(listing: DataFrame, uri: str) -> DataFrame:
    """(path, length, content) of listed files, in tasks of a bounded number of files and bytes."""
    n, size = listing.agg(F.count("*"), F.sum("length")).first()
    parts = max(listing.sparkSession.sparkContext.defaultParallelism, -(-n // FILES_PER_TASK), -(-(size or 0) // BYTES_PER_TASK))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(uri)
        base, names = base.rstrip("/"), ["path", "length", "content"]
        paths, lengths, contents, held = [], [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(contents, pa.binary())], names)
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                if paths and held + length > BYTES_HELD:
                    yield out()
                    paths, lengths, contents, held = [], [], [], 0
                with system.open_input_stream(f"{base}/{path}") as file:
                    contents.append(file.read())
                paths.append(path)
                lengths.append(length)
                held += length
        if paths:
            yield out()

    return listing.select("path", "length").repartition(parts).mapInArrow(read, "path string, length long, content binary")


def read_corpus(spark: SparkSession, root: str, max_bytes: int | None = None, max_depth: int | None = None) -> DataFrame:
    """(path, bytes, text, is_binary, skipped) of the text files below ``root``.

    No text for binary files. With limits, the text of larger files and files in deeper folders is not read, and ``skipped`` says
    ``size`` or ``depth``; every file keeps its row. Tasks list the files and read those that are wanted, many small ones each. A folder that
    only Spark opens is read by Spark, a few files to a task.
    """
    listing = corpus_listing(spark, root)
    base = re.sub(r"^file:/*", "", root.rstrip("/"))
    below = F.regexp_replace(F.regexp_replace("path", "^file:/*", ""), "^/?" + re.escape(base.lstrip("/")) + "/", "")
    rel = F.col("path") if listing else below
    files = listing[1] if listing else spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    folders = F.slice(F.split(rel, "/"), F.lit(1), F.size(F.split(rel, "/")) - 1)
    name = F.element_at(F.split(rel, "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    wanted = files.where(~F.arrays_overlap(folders, F.array(*[F.lit(f) for f in IGNORED_FOLDERS])) & suffix.isin(*TEXT_SUFFIXES))
    large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    deep = F.lit(False) if max_depth is None else F.size(folders) > max_depth
    skipped = F.when(large, "size").when(deep, "depth")
    rows = lambda df, content, binary: df.select(rel.alias("path"), F.col("length").alias("bytes"), content.alias("text"), binary.alias("is_binary"), skipped.alias("skipped"))
    # A binary file has a zero byte near its start.
    binary = F.position(F.lit(bytearray(b"\0")), F.substring("content", 1, SAMPLE_BYTES)) > 0
    whole = wanted.where(~large & ~deep)
    read = rows(read_files(whole, listing[0]) if listing else whole, F.when(~binary, F.expr("decode(content, 'UTF-8')")), binary)
    if max_bytes is None and max_depth is None:
        return read
    return read.unionByName(rows(wanted.where(large | deep), F.lit(None).cast("string"), F.lit(None).cast("boolean")))


def safe_id(request_id: Column) -> Column:
    return F.regexp_replace(request_id, r"[^A-Za-z0-9_.-]", "_")


def read_network_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of captured requests with their bodies; the file name before the first mark is the request."""
    schema = "url STRING, method STRING, status INT, mimeType STRING, reqHeaders MAP<STRING, STRING>, respHeaders MAP<STRING, STRING>"
    meta = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").schema(schema).json(root)
    meta = meta.select(F.regexp_replace(file_name(), r"\.meta\.json$", "").alias("request"), "*")
    body = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.body.*").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    body = body.select(F.regexp_replace(name, r"\.body\.[^.]*$", "").alias("request"), F.expr("decode(content, 'UTF-8')").alias("body"))
    return meta.join(body, "request", "left")
