"""Queries that apply one column builder to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import registry
from textloom.functions import text as tx
from textloom.functions.folding import fold_key, normalize_text
from textloom.operators.corpus import id_set_changes
from textloom.operators.ordered import ordered_scan, slices
from textloom.plans.catalog import query
from textloom.plans.inputs import load


#: Pages of which one task compares neighbours.
PAGES_PER_SLICE = 10_000


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '…[+' || (length(text) - 2000) || ' chars]' ELSE text END AS text FROM $documents")
def clip_text(spark, folder):
    return load(spark, folder, "SELECT doc_id, text FROM $documents").select("doc_id", tx.clip(F.col("text"), 2000).alias("text"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM $documents")
def estimate_tokens(spark, folder):
    return load(spark, folder, "SELECT doc_id, text FROM $documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query("""SELECT doc_id, len(s) - 1 AS hits, length(s[1]) AS first_start, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS outside
          FROM (SELECT doc_id, string_split_regex(text, '[A-Z][a-z]+') AS s FROM $documents) x WHERE len(s) > 1""")
def regex_spans(spark, folder):
    rows = load(spark, folder, "SELECT doc_id, text FROM $documents").withColumn("s", tx.regex_spans(F.col("text"), "[A-Z][a-z]+"))
    inside = F.aggregate("s", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return rows.where(F.size("s") > 0).select(
        "doc_id", F.size("s").alias("hits"), F.col("s")[0]["start"].alias("first_start"), (F.length("text") - inside).cast("bigint").alias("outside")
    )


@query("""SELECT doc_id, len(string_split(left(text, p), chr(10))) AS line,
          string_split(text, chr(10))[len(string_split(left(text, p), chr(10)))] AS hit FROM
          (SELECT doc_id, text, length(string_split_regex(text, '[0-9]+')[1]) AS p FROM $documents WHERE regexp_matches(text, '[0-9]+')) x""")
def match_context(spark, folder):
    rows = load(spark, folder, "SELECT doc_id, text FROM $documents").withColumn("s", F.get(tx.regex_spans(F.col("text"), "[0-9]+"), F.lit(0)))
    rows = rows.where("s is not null").withColumn("c", tx.match_context(F.col("text"), F.col("s.start"), F.col("s.end")))
    # The window around the hit is wider than most lines; where it is not, the line is taken whole for the comparison.
    whole = F.element_at(F.split("text", "\n", -1), F.col("c.line"))
    cut = F.col("c.hit").startswith("… ") | F.col("c.hit").endswith(" …")
    inside = F.contains(whole, F.regexp_replace("c.hit", "^… | …$", ""))
    return rows.select("doc_id", "c.line", F.when(cut & inside, whole).otherwise(F.col("c.hit")).alias("hit"))


@query("""SELECT doc_id, n, len(string_split(left(text, p), chr(10))) AS line, string_split(text, chr(10))[len(string_split(left(text, p), chr(10)))] AS hit FROM
          (SELECT doc_id, text, n, CAST(coalesce(list_sum(list_transform(s[1:n], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:n - 1], lambda x: length(x))), 0) AS BIGINT) AS p FROM
          (SELECT doc_id, text, s, m, unnest(range(1, len(m) + 1)) AS n FROM
          (SELECT doc_id, text, string_split_regex(text, '[0-9]+') AS s, regexp_extract_all(text, '[0-9]+') AS m FROM $documents) x) y) z""")
def match_context_all(spark, folder):
    """Every match of a text, numbered from 1."""
    rows = load(spark, folder, "SELECT doc_id, text FROM $documents")
    rows = rows.select("doc_id", "text", F.posexplode(tx.regex_spans(F.col("text"), "[0-9]+")).alias("i", "s"))
    rows = rows.withColumn("c", tx.match_context(F.col("text"), F.col("s.start"), F.col("s.end")))
    whole = F.element_at(F.split("text", "\n", -1), F.col("c.line"))
    cut = F.col("c.hit").startswith("… ") | F.col("c.hit").endswith(" …")
    inside = F.contains(whole, F.regexp_replace("c.hit", "^… | …$", ""))
    return rows.select("doc_id", (F.col("i") + 1).alias("n"), "c.line", F.when(cut & inside, whole).otherwise(F.col("c.hit")).alias("hit"))


_SPANS = """SELECT doc_id, text, m[n] AS value, n, CAST(coalesce(list_sum(list_transform(s[1:n], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:n - 1], lambda x: length(x))), 0) AS INT) AS p FROM
          (SELECT doc_id, text, s, m, unnest(range(1, len(m) + 1)) AS n FROM
          (SELECT doc_id, text, string_split_regex(text, '[0-9]+') AS s, regexp_extract_all(text, '[0-9]+') AS m FROM $documents) x) y"""
_SHORT = "list_transform({}, lambda x: left(x, 320) || CASE WHEN length(x) > 320 THEN ' …' ELSE '' END)"
_CONTEXT = f"""
    SELECT doc_id, p AS start, line, array_to_string({_SHORT.format('ls[greatest(1, line - 2):line - 1]')}, chr(10)) AS before, array_to_string({_SHORT.format('ls[line + 1:line + 2]')}, chr(10)) AS after,
           CASE WHEN p - 160 > b THEN '… ' ELSE '' END || substr(text, greatest(b, p - 160) + 1, least(e, q + 160) - greatest(b, p - 160)) || CASE WHEN q + 160 < e THEN ' …' ELSE '' END AS hit
    FROM (SELECT *, b + length(ls[line]) AS e FROM (SELECT *, CAST(coalesce(list_sum(list_transform(ls[1:line - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS b FROM
         (SELECT *, len(string_split(left(text, p), chr(10))) AS line, string_split(text, chr(10)) AS ls, p + length(value) AS q FROM ({_SPANS}) x) y) z) w"""


def in_session(spark, folder, name):
    """The functions of the library in this session, and a table to call them on."""
    registry.register_all(spark)
    return f"parquet.`{folder}/{name}.parquet`"


@query(_CONTEXT)
def match_context_lines(spark, folder):
    """The lines around every match, the hit line as it is cut, and its place."""
    rows = load(spark, folder, "SELECT doc_id, text FROM $documents")
    rows = rows.select("doc_id", "text", F.explode(tx.regex_spans(F.col("text"), "[0-9]+")).alias("s"))
    rows = rows.withColumn("c", tx.match_context(F.col("text"), F.col("s.start"), F.col("s.end")))
    return rows.select("doc_id", "s.start", "c.line", F.array_join("c.before", "\n").alias("before"), F.array_join("c.after", "\n").alias("after"), "c.hit")


@query(_CONTEXT)
def sql_match_context(spark, folder):
    """The same through SQL text: a table function beside each row, and a native function."""
    docs = in_session(spark, folder, "documents")
    return spark.sql(f"""SELECT doc_id, start, c.line, array_join(c.before, '\n') AS before, array_join(c.after, '\n') AS after, c.hit FROM
        (SELECT d.doc_id, s.start, match_context(d.text, s.start, s.end) AS c FROM {docs} d, LATERAL regex_spans(d.text, '[0-9]+') s) x""")


@query(f"SELECT doc_id, p AS start, p + length(value) AS stop, value FROM ({_SPANS}) x")
def sql_regex_spans(spark, folder):
    docs = in_session(spark, folder, "documents")
    return spark.sql(f"SELECT d.doc_id, s.start, s.end AS stop, s.value FROM {docs} d, LATERAL regex_spans(d.text, '[0-9]+') s")


@query("""SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '…[+' || (length(text) - 2000) || ' chars]' ELSE text END AS text,
          CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS some,
          regexp_replace(lower(text), '[\\s.‐-―-]', '', 'g') AS norm FROM $documents""")
def sql_text_functions(spark, folder):
    docs = in_session(spark, folder, "documents")
    return spark.sql(f"SELECT doc_id, clip(text, 2000) AS text, estimate_tokens(text) AS tokens, slice_lines(text, 2, 3) AS some, decision_value(text) AS norm FROM {docs}")


@query("""SELECT page_id, coalesce(regexp_extract(t, 'href="([^"]*)"', 1), '') AS href, coalesce(regexp_extract(t, 'lang="([^"]*)"', 1), '') AS lang
          FROM (SELECT page_id, regexp_extract(html, '<html[^>]*>') || regexp_extract(html, '<a[^>]*>') AS t FROM $pages) x""")
def extract_attributes(spark, folder):
    rows = load(spark, folder, "SELECT page_id, regexp_extract(html, '<html[^>]*>', 0) || regexp_extract(html, '<a[^>]*>', 0) AS t FROM $pages")
    m = tx.extract_attributes(F.col("t"))
    get = lambda k: F.coalesce(m[k], F.lit("")).alias(k)
    return rows.select("page_id", get("href"), get("lang"))


@query("""SELECT page_id, n, coalesce(regexp_extract(t, 'href="([^"]*)"', 1), '') AS href, coalesce(regexp_extract(t, 'lang="([^"]*)"', 1), '') AS lang FROM
          (SELECT page_id, unnest(range(1, len(m) + 1)) AS n, unnest(m) AS t FROM (SELECT page_id, regexp_extract_all(html, '<[a-zA-Z][^>]*>') AS m FROM $pages) x) y""")
def extract_attributes_all(spark, folder):
    """Every tag of a page, numbered from 1."""
    rows = load(spark, folder, "SELECT page_id, html FROM $pages")
    rows = rows.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<[a-zA-Z][^>]*>"), F.lit(0))).alias("i", "t"))
    m = tx.extract_attributes(F.col("t"))
    get = lambda k: F.coalesce(m[k], F.lit("")).alias(k)
    return rows.select("page_id", (F.col("i") + 1).alias("n"), get("href"), get("lang"))


@query("""SELECT event_id, 'GET /u/' || session || '?k=' || k || '&miss=${token}' AS filled, 'token' AS missing FROM $ev""")
def fill_template(spark, folder):
    rows = load(spark, folder, "ev")
    values = F.create_map(F.lit("user"), "session", F.lit("k"), F.col("k").cast("string"))
    filled = tx.fill_template(F.concat(F.lit("GET /u/${user}?k=${k}&miss=${token}"), F.lit("")), values)
    rows = rows.select("event_id", filled.alias("filled"))
    return rows.withColumn("missing", F.array_join(tx.unresolved_placeholders(F.col("filled")), ","))


@query("""SELECT event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(raw, '[$][{]([^}]+)[}]', 1))), ',') AS names FROM $failures""")
def unresolved_placeholders(spark, folder):
    return load(spark, folder, "failures").select("event_id", F.array_join(tx.unresolved_placeholders(F.col("raw")), ",").alias("names"))


@query("""SELECT event_id, greatest(greatest(coalesce(CASE WHEN k % 4 <> 0 AND k - 20 > 0 THEN k - 20 END, CASE WHEN k % 3 = 0 AND k > 0 THEN k / 2.0 END, 1),
                 coalesce(CASE WHEN k % 3 = 0 AND k > 0 THEN k / 2.0 END, CASE WHEN k % 4 <> 0 AND k - 20 > 0 THEN k - 20 END, 1)) * 1000.0::DOUBLE, 500 * pow(2, k % 6)) AS wait_ms FROM $ev""")
def retry_wait(spark, folder):
    rows = load(spark, folder, "ev")
    header = F.when(F.col("k") % 4 == 0, F.lit("soon")).otherwise((F.col("k") - 20).cast("string"))
    body = F.when(F.col("k") % 3 == 0, (F.col("k") / 2).cast("string"))
    return rows.select("event_id", tx.retry_wait_ms(header, body, F.col("k") % 6).alias("wait_ms"))


@query("""SELECT event_id, CASE WHEN k % 2 = 0 THEN 'x_' || event_type END AS extras FROM $ev""")
def vendor_extras(spark, folder):
    rows = load(spark, folder, """SELECT event_id, '{"role":"a","content":' || CAST(k AS STRING) || CASE WHEN k % 2 = 0 THEN ',"x_' || event_type || '":1' ELSE '' END || '}' AS j FROM $ev""")
    return rows.select("event_id", F.array_join(tx.vendor_extras(F.col("j"), tx.MESSAGE_FIELDS), ",").alias("extras"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'rate-limit  →  sleep ' || k || 'ms' WHEN 'view' THEN 'usage  →  ' || props
          WHEN 'error' THEN 'error: bad ' || k WHEN 'signup' THEN 'chat_completions  →  finish=stop  tokens=' || k || '  (' || k || 'ms)' ELSE props END AS summary FROM $ev""")
def summarize_events(spark, folder):
    rows = load(spark, folder, """SELECT event_id, CASE event_type WHEN 'click' THEN 'rate-limit' WHEN 'view' THEN 'usage' WHEN 'error' THEN 'error'
        WHEN 'signup' THEN 'chat_completions' ELSE 'other' END AS kind,
        CASE event_type WHEN 'click' THEN '{"ms":' || CAST(k AS STRING) || '}' WHEN 'error' THEN '{"message":"bad ' || CAST(k AS STRING) || '"}'
        WHEN 'signup' THEN '{"durationMs":' || CAST(k AS STRING) || ',"response":{"choices":[{"finish_reason":"stop"}],"usage":{"total_tokens":' || CAST(k AS STRING) || '}}}'
        ELSE props END AS payload FROM $ev""")
    return rows.select("event_id", tx.summarize_event(F.col("kind"), F.col("payload")).alias("summary"))


_LINES = "len(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(13)) <> ''))"


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN left(string_split(text, chr(10))[1], 140) WHEN 1 THEN {_LINES} || ' entries'
           WHEN 2 THEN 'Read ' || len(string_split(text, chr(10))) || ' lines' WHEN 3 THEN {_LINES} || ' matching lines' ELSE length(text) || ' bytes' END AS summary FROM $documents""")
def summarize_tool_results(spark, folder):
    rows = load(spark, folder, "SELECT doc_id, text FROM $documents")
    kind = F.col("doc_id") % 5
    verb = F.when(kind == 1, "list").when(kind == 2, "read_file").when(kind == 3, "search").otherwise("info")
    status = F.when(kind == 0, "error").otherwise("ok")
    return rows.select("doc_id", tx.summarize_tool_result(verb, status, F.col("text")).alias("summary"))


@query("SELECT conv_id, turn, text || '!' || role AS text FROM $conversations")
def flatten_content(spark, folder):
    rows = load(spark, folder, "SELECT conv_id, turn, role, text FROM $conversations")
    part = F.struct(F.lit("text").alias("type"), F.col("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))
    parts = F.concat(F.lit("["), F.to_json(part), F.lit(","), F.to_json(image), F.lit(',"!",'), F.to_json(F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))), F.lit("]"))
    plain = F.to_json(F.array(F.concat("text", F.lit("!"), "role")))
    content = F.when(F.col("turn") % 2 == 0, F.parse_json(parts)).otherwise(F.try_variant_get(F.parse_json(plain), "$[0]", "variant"))
    return rows.select("conv_id", "turn", tx.flatten_content(content).alias("text"))


@query("SELECT event_id, CASE WHEN k % 9 = 0 THEN '(empty)' ELSE substr('key-' || event_type || '-' || k, 1, 8) || '…' END AS key FROM $ev")
def redact_keys(spark, folder):
    rows = load(spark, folder, "SELECT event_id, CASE WHEN k % 9 = 0 THEN NULL ELSE 'key-' || event_type || '-' || CAST(k AS STRING) END AS key FROM $ev")
    return rows.select("event_id", tx.redact_key(F.col("key")).alias("key"))


@query("""SELECT event_id, 'app' || (user_id % 5) AS app, CASE WHEN k % 2 = 0 THEN 'A' || k || '.java' ELSE 'B' || k || '.java' END AS file, k % 2 = 0 AS ok,
          CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) / 10 END AS seconds, CASE WHEN k % 2 = 1 THEN 'B' || k || '.java:42 cannot find symbol' END AS error FROM $ev WHERE k % 5 > 0""")
def reload_markers(spark, folder):
    rows = load(spark, folder, """SELECT event_id, CASE WHEN k % 5 = 0 THEN props WHEN k % 2 = 0 THEN
        '=== reload app' || CAST(user_id % 5 AS STRING) || ': A' || CAST(k AS STRING) || '.java → compile OK, context rebuilt in ' || CAST(k DIV 10 AS STRING) || '.' || CAST(k % 10 AS STRING) || 's ==='
        ELSE '=== reload app' || CAST(user_id % 5 AS STRING) || ': COMPILE FAILED — B' || CAST(k AS STRING) || '.java:42 cannot find symbol ===' END AS line FROM $ev""")
    out = rows.select("event_id", tx.reload_marker(F.col("line")).alias("m")).where("m is not null")
    return out.select("event_id", "m.*")


@query("""SELECT page_id, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS added,
          array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS removed FROM
          (SELECT page_id, list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS b,
                  list_distinct(regexp_extract_all(lag(html, 1, '') OVER (ORDER BY page_id), 'href="([^"]*)"', 1)) AS a FROM $pages) x""")
def id_set_changes_of_links(spark, folder):
    pages = load(spark, folder, "SELECT page_id, html FROM $pages")
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    own = pages.select("page_id", links.alias("b"))
    # Page ids may have gaps: the page before is the one with the next smaller id.
    both = ordered_scan(own, [], ["page_id"], slices(own, [], ["page_id"], PAGES_PER_SLICE), previous={"a": F.col("b")})
    both = both.withColumn("a", F.coalesce("a", F.array().cast("array<string>")))
    d = id_set_changes(F.col("a"), F.col("b"))
    return both.select("page_id", F.array_join(F.array_sort(d["added"]), ",").alias("added"), F.array_join(F.array_sort(d["removed"]), ",").alias("removed"))


@query("""SELECT doc_id, regexp_replace(lower(text), '[ \\t\\n\\r\\v\\f\\xA0]+', ' ', 'g') AS norm FROM $documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')""")
def normalize_ascii_text(spark, folder):
    rows = load(spark, folder, "SELECT doc_id, text FROM $documents").where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return rows.select("doc_id", fold_key("text").alias("norm"))


@query()
def normalize_all_text(spark, folder):
    rows = load(spark, folder, "SELECT doc_id, text FROM $documents")
    return rows.select("doc_id", normalize_text("text").alias("n")).select("doc_id", "n.norm", F.size("n.starts").alias("length"))
