"""Queries over session events, requests and page changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.web import classify_request, source_key
from textloom.operators import events, requests
from textloom.plans.catalog import query
from textloom.plans.inputs import load

_LIFE = """
    WITH first AS (SELECT session, request_id, min(event_id) AS e0, arg_min(t, event_id) AS t0,
                          count(*) - 1 AS redirects, arg_max(url, event_id) AS url, arg_max(method, event_id) AS method
                   FROM $network WHERE event = 'sent' GROUP BY ALL),
         later AS (SELECT n.*, f.t0 FROM $network n JOIN first f USING (session, request_id) WHERE n.event_id > f.e0)
    SELECT f.session, f.request_id, f.method, f.url, f.t0, f.redirects,
           max(CASE WHEN l.event = 'response' THEN l.event_id END) AS re,
           arg_max(l.status, l.event_id) FILTER (l.event = 'response') AS status,
           arg_max(l.mime, l.event_id) FILTER (l.event = 'response') AS mime,
           arg_max(l.t, l.event_id) FILTER (l.event IN ('finished', 'failed')) AS done,
           arg_max(l.size, l.event_id) FILTER (l.event = 'finished') AS size,
           arg_max(l.error, l.event_id) FILTER (l.event = 'failed') AS failed
    FROM first f LEFT JOIN later l ON l.session = f.session AND l.request_id = f.request_id
    GROUP BY f.session, f.request_id, f.method, f.url, f.t0, f.redirects
"""
LIFE = f"SELECT session, request_id, method, url, t0, status, mime, done, size, failed, redirects, done - t0 AS ms FROM ({_LIFE}) q"


def network(spark, folder):
    return load(spark, folder, "network")


@query("SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY t, event_id) AS seq FROM $ev")
def sequence_events(spark, folder):
    return events.sequence_events(load(spark, folder, "SELECT session, event_id, t FROM $ev")).select("session", "event_id", "seq")


@query("""SELECT session, event_id, t FROM
          (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t DESC, event_id DESC) AS r FROM $ev) x WHERE r <= 20""")
def ring_buffer(spark, folder):
    return events.ring_buffer(load(spark, folder, "SELECT session, event_id, t FROM $ev"), 20)


@query("""SELECT session, event_type, event_id FROM
          (SELECT *, row_number() OVER (PARTITION BY session, event_type ORDER BY t DESC, event_id DESC) AS r FROM $ev
           WHERE t >= 1704700000000) x WHERE r <= 5""")
def ring_buffer_by_kind(spark, folder):
    rows = load(spark, folder, "SELECT session, event_type, event_id, t FROM $ev")
    return events.ring_buffer(rows, 5, ("session", "event_type"), oldest=1704700000000).drop("t")


@query("""SELECT session, event_id, seq FROM (SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY t, event_id) AS seq
          FROM $ev) x WHERE seq > 40""")
def read_since(spark, folder):
    rows = events.sequence_events(load(spark, folder, "SELECT session, event_id, t FROM $ev"))
    return events.read_since(rows, 40)[0].select("session", "event_id", "seq")


@query("SELECT max(event_id) AS cursor FROM $events")
def next_cursor(spark, folder):
    return events.read_since(load(spark, folder, "SELECT event_id AS seq FROM $events"), 0)[1]


@query("SELECT session, event_id, level, text FROM $console WHERE level IN ('warning', 'warn') AND t > 1705000000000")
def filter_console(spark, folder):
    return events.filter_console(load(spark, folder, "console"), "warning", 1705000000000).select("session", "event_id", "level", "text")


@query(LIFE)
def request_lifecycle(spark, folder):
    return events.request_lifecycle(network(spark, folder))


@query(f"SELECT session, request_id, url, status, failed FROM ({LIFE}) q WHERE (failed IS NOT NULL OR status >= 400) AND contains(url, '/click/')")
def filter_network(spark, folder):
    rows = events.filter_network(events.request_lifecycle(network(spark, folder)), "/click/", failed_only=True)
    return rows.select("session", "request_id", "url", "status", "failed")


@query("""SELECT session, request_id, arg_max(url, event_id) AS url, arg_max(method, event_id) AS method, count(*) - 1 AS redirects
          FROM $network WHERE event = 'sent' GROUP BY session, request_id""")
def collapse_redirects(spark, folder):
    return events.collapse_redirects(network(spark, folder))


_MERGED = """SELECT session, t, 'console' AS kind, text FROM $console
             UNION ALL SELECT session, t, 'action', action FROM $actions
             UNION ALL SELECT session, t, 'dom', node FROM $changes"""


def merged(spark, folder):
    dom = load(spark, folder, "changes").withColumnRenamed("node", "text")
    done = load(spark, folder, "actions").withColumnRenamed("action", "text")
    return events.merge_timeline(console=load(spark, folder, "console"), action=done, dom=dom)


@query(_MERGED)
def merge_timeline(spark, folder):
    return merged(spark, folder)


@query(f"SELECT session, t, kind, text FROM ({_MERGED}) m WHERE kind = 'dom' AND t > 1705500000000")
def timeline(spark, folder):
    return events.timeline(merged(spark, folder), "dom", 1705500000000)[0]


@query(f"SELECT max(t) AS cursor FROM ({_MERGED}) m WHERE kind = 'console'")
def timeline_cursor(spark, folder):
    return events.timeline(merged(spark, folder), "console")[1]


@query("""SELECT c.session, c.event_id, c.node, a.action AS cause FROM $changes c ASOF LEFT JOIN $actions a
          ON c.session = a.session AND c.event_id >= a.event_id""")
def attribute_changes(spark, folder):
    rows = events.attribute_changes(load(spark, folder, "SELECT session, event_id, t, node FROM $changes"), load(spark, folder, "actions"))
    return rows.select("session", "event_id", "node", "cause")


@query("""SELECT c.session, c.event_id, a.cause FROM $changes c LEFT JOIN
          (SELECT session, arg_max(action, event_id) AS cause FROM $actions GROUP BY session) a USING (session)""")
def attribute_changes_drained(spark, folder):
    rows = events.attribute_changes(load(spark, folder, "changes"), load(spark, folder, "actions"), drained=True)
    return rows.select("session", "event_id", "cause")


@query("""SELECT c.session, c.event_id, coalesce(a.action || ' → ', '') ||
          CASE c.k % 4 WHEN 0 THEN '+' || c.node || ', +p  -' || c.node WHEN 1 THEN '-' || c.node
               WHEN 2 THEN '(dom change)' ELSE '~' || c.node || ' [class]' END AS summary
          FROM $changes c ASOF LEFT JOIN $actions a ON c.session = a.session AND c.event_id >= a.event_id""")
def dom_change_summary(spark, folder):
    rows = load(spark, folder, "changes")
    none = F.array().cast("array<string>")
    pick = lambda *by: F.coalesce(*[F.when(F.col("k") % 4 == i, F.array(*names)) for i, names in by], none)
    rows = rows.withColumns(
        {
            "added": pick((0, ["node", F.lit("p")])),
            "removed": pick((0, ["node"]), (1, ["node"])),
            "attr": pick((3, [F.concat("node", F.lit(" [class]"))])),
        }
    )
    rows = events.attribute_changes(rows, load(spark, folder, "actions"))
    return events.describe_changes(rows).select("session", "event_id", "summary")


_SNAP = """SELECT split_part(regexp_extract(url, '^https?://([^/]+)', 1), '.', 1) AS session, page_id,
           replace(replace(html, '<li>', '<li id="i' || CAST(page_id AS STRING) || '">'), '<h1>', '<h1 id="t' || CAST(page_id % 3 AS STRING) || '">') AS html
           FROM $pages"""
_IDS = "list_distinct(regexp_extract_all({0}, 'id=\"([^\"]*)\"', 1))"


@query(f"""
    WITH s AS ({_SNAP}), p AS (SELECT *, lag(html) OVER (PARTITION BY session ORDER BY page_id) AS b FROM s),
    d AS (SELECT session, page_id, b, (length(html) - length(replace(html, '<', ''))) - (length(b) - length(replace(b, '<', ''))) AS n,
          {_IDS.format('html')} AS new, {_IDS.format('b')} AS old FROM p),
    e AS (SELECT *, list_sort(list_filter(new, lambda x: NOT list_contains(old, x))) AS a, list_sort(list_filter(old, lambda x: NOT list_contains(new, x))) AS r FROM d)
    SELECT session, page_id, CASE WHEN b IS NULL THEN 'initial snapshot' ELSE
        CASE WHEN n > 0 THEN '~+' || n || ' tags' WHEN n < 0 THEN '~' || n || ' tags' ELSE 'no tag-count change' END
        || '; +ids: ' || CASE WHEN len(a) = 0 THEN '(none)' ELSE array_to_string(a[:5], ', ') END
        || '; -ids: ' || CASE WHEN len(r) = 0 THEN '(none)' ELSE array_to_string(r[:5], ', ') END END AS summary FROM e""")
def snapshot_diffs(spark, folder):
    pages = load(spark, folder, _SNAP)
    # Both ids of a page sort as they occur, so the text is the same however a set is ordered.
    return events.snapshot_diffs(pages, ["page_id"]).select("session", "page_id", "summary")


@query("""SELECT session, event_id, t - b AS gap_ms FROM
          (SELECT *, lag(t) OVER (PARTITION BY session ORDER BY t, event_id) AS b FROM $ev) x WHERE t - b > 36000000""")
def stall_gaps(spark, folder):
    rows = events.stall_gaps(load(spark, folder, "SELECT session, event_id, t FROM $ev"), ["session"], limit_ms=36_000_000)
    return rows.select("session", "event_id", "gap_ms")


_KINDS = """SELECT session, event_id, t, CASE event_type WHEN 'signup' THEN 'request' WHEN 'purchase' THEN 'response' ELSE 'dom' END AS kind FROM $ev"""


@query(f"""
    WITH a AS (SELECT *, CASE kind WHEN 'request' THEN 1 WHEN 'response' THEN -1 ELSE 0 END AS s FROM ({_KINDS}) k),
    b AS (SELECT *, sum(s) OVER w - s AS open, lag(t) OVER w AS p FROM a WINDOW w AS (PARTITION BY session ORDER BY t, event_id)),
    c AS (SELECT *, CASE WHEN p IS NULL OR (t - p >= 14400000 AND open <= 0) THEN 1 ELSE 0 END AS f FROM b),
    d AS (SELECT *, sum(f) OVER (PARTITION BY session ORDER BY t, event_id) AS g FROM c)
    SELECT session, min(t) AS started, max(t) AS last, count(*) AS events, count(*) FILTER (kind = 'dom') AS mutations,
           max(t) + 14400000 AS settled, CAST(max(t) + 14400000 - min(t) > 86400000 AS INT) AS timed_out FROM d GROUP BY session, g""")
def settle_windows(spark, folder):
    rows = events.settle_windows(load(spark, folder, _KINDS), 14_400_000, 86_400_000)
    return rows.withColumn("timed_out", F.col("timed_out").cast("int"))


LOOPS = """
    SELECT *, row_number() OVER (PARTITION BY session, g ORDER BY t, event_id) AS repeat FROM (
      SELECT *, sum(c) OVER (PARTITION BY session ORDER BY t, event_id) AS g FROM (
        SELECT *, CASE WHEN lag(verb || '|' || args) OVER (PARTITION BY session ORDER BY t, event_id) = verb || '|' || args THEN 0 ELSE 1 END AS c
        FROM $calls) x) y"""


@query(f"SELECT session, event_id, verb, args, repeat, CAST(repeat >= 3 AS INT) AS looped FROM ({LOOPS}) z")
def detect_loops(spark, folder):
    rows = events.detect_loops(load(spark, folder, "calls"))
    return rows.select("session", "event_id", "verb", "args", "repeat", F.col("looped").cast("int").alias("looped"))


@query("SELECT 'p' || CAST(user_id AS STRING) AS project, max(t) AS opened FROM $ev GROUP BY 1 ORDER BY opened DESC, project LIMIT 12")
def recent_projects(spark, folder):
    return events.recent_projects(load(spark, folder, "SELECT 'p' || CAST(user_id AS STRING) AS project, t FROM $ev"))


@query("""
    SELECT p.page_id, p.path, r.route FROM $paths p LEFT JOIN (
      SELECT path, route FROM (SELECT q.path, r.route, row_number() OVER (PARTITION BY q.path ORDER BY
             CASE WHEN r.pattern = q.path THEN 0 WHEN ends_with(r.pattern, '/*') THEN 1 ELSE 2 END, length(r.pattern) DESC, r.pattern) AS n
        FROM (SELECT DISTINCT path FROM $paths) q JOIN $routes r ON r.pattern = q.path
          OR (ends_with(r.pattern, '/*') AND starts_with(q.path || '/', substr(r.pattern, 1, length(r.pattern) - 1)))
          OR (starts_with(r.pattern, '*.') AND ends_with(q.path, substr(r.pattern, 2)))) z WHERE n = 1) r USING (path)""")
def route_attribution(spark, folder):
    rows = events.route_attribution(load(spark, folder, "paths"), load(spark, folder, "routes"))
    return rows.select("page_id", "path", "route")


_CHAT = "SELECT *, last_value(CASE WHEN kind = 'new' THEN response_id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t, event_id) AS cid FROM $captured"
TEMPLATED = f"""SELECT session, event_id, t, kind,
    CASE WHEN kind = 'new' OR cid IS NULL THEN url ELSE replace(url, cid, '${{chat_id}}') END AS url,
    CASE WHEN kind = 'new' OR cid IS NULL THEN body ELSE replace(body, cid, '${{chat_id}}') END AS body FROM ({_CHAT}) c"""


@query(f"SELECT session, event_id, url, body FROM ({TEMPLATED}) x")
def template_requests(spark, folder):
    return requests.template_requests(load(spark, folder, "captured")).select("session", "event_id", "url", "body")


@query(f"""
    SELECT session, event_id, CAST(g AS BIGINT) AS "group", CASE WHEN kind <> 'new' AND g > 0 AND g % 5 > 0 THEN replace(url, '${{chat_id}}', 'new-' || session || '-' || g) ELSE url END AS url
    FROM (SELECT *, sum(CASE WHEN kind = 'new' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t, event_id) AS g FROM ({TEMPLATED}) x) y""")
def replay_plan(spark, folder):
    templates = requests.template_requests(load(spark, folder, "captured"))
    opened = load(spark, folder, "SELECT session, t, event_id, row_number() OVER (PARTITION BY session ORDER BY t, event_id) AS grp FROM $captured WHERE kind = 'new'")
    ids = opened.where("grp % 5 > 0").select("session", F.col("grp").alias("group"), F.concat_ws("-", F.lit("new"), "session", F.col("grp").cast("string")).alias("new_id"))
    return requests.replay_plan(templates, ids).select("session", "event_id", F.col("group").cast("bigint").alias("group"), "url")


@query("""SELECT event_id, CASE WHEN regexp_matches(lower(url), 'count|pinned|/tags|page') THEN 'excluded'
          WHEN regexp_matches(url, '^.*/api/v1/chats/new$') THEN 'new' WHEN regexp_matches(url, '^.*/api/chat/completions$') THEN 'completion'
          WHEN regexp_matches(url, '^.*/api/chat/completed$') THEN 'completed'
          WHEN regexp_matches(url, '^.*/api/v1/chats/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN 'chat'
          ELSE 'unwatched' END AS kind FROM $captured""")
def classify_requests(spark, folder):
    return load(spark, folder, "captured").select("event_id", classify_request(F.col("url")).alias("kind"))


@query("""SELECT page_id, 'browser:s' || (page_id % 5) || '@' || regexp_extract(url, '^([^?#]*)', 1) AS source_key FROM $pages""")
def source_keys(spark, folder):
    pages = load(spark, folder, "SELECT page_id, url, 's' || CAST(page_id % 5 AS STRING) AS label FROM $pages")
    return pages.select("page_id", source_key(F.col("label"), F.col("url")).alias("source_key"))


@query("""SELECT conv_id AS tree, turn AS node, 0 AS root, CASE WHEN turn < 2 THEN turn ELSE 1 + turn // 2 END AS depth FROM (
            SELECT conv_id, turn FROM $conversations) x""", name="thread_tree")
def thread_tree(spark, folder):
    # Turn 1 answers turn 0; turns 2n and 2n + 1 answer turn 2n - 1 or, where that is the first, turn 1.
    nodes = load(spark, folder, """SELECT conv_id AS tree, turn AS node,
        CASE WHEN turn = 0 THEN NULL WHEN turn = 1 THEN 0 WHEN turn < 4 THEN 1 ELSE (turn DIV 2) * 2 - 1 END AS parent_id FROM $conversations""")
    return requests.thread_tree(nodes)


_C = "SELECT session, request_id AS call_id FROM $network WHERE event = 'sent'"
_R = "SELECT session, request_id AS call_id FROM $network WHERE event = 'response'"


@query(f"""SELECT session, call_id, coalesce(c.n, 0) AS calls, coalesce(r.n, 0) AS results,
           CASE WHEN r.n IS NULL THEN 'no_result' WHEN c.n IS NULL THEN 'no_call' ELSE 'matched' END AS status
           FROM (SELECT session, call_id, count(*) AS n FROM ({_C}) a GROUP BY ALL) c
           FULL JOIN (SELECT session, call_id, count(*) AS n FROM ({_R}) b GROUP BY ALL) r USING (session, call_id)""")
def tool_flow(spark, folder):
    return requests.tool_flow(load(spark, folder, _C), load(spark, folder, _R))


@query("""SELECT session, CASE WHEN bool_or(verdict = 'good' AND n IN (2, 3, 4)) THEN 'client tools work'
          WHEN bool_or(verdict = 'good' AND n = 5) THEN 'message tools work'
          WHEN count(*) < 6 THEN 'incomplete (' || count(*) || '/6)' ELSE 'no client tools' END AS overall FROM $probes GROUP BY session""")
def probe_rollup(spark, folder):
    return requests.probe_rollup(load(spark, folder, "probes"), ["session"])


@query("SELECT session, h1 AS name, arg_max(v1, event_id) AS value FROM $probes GROUP BY ALL")
def header_union(spark, folder):
    rows = load(spark, folder, "probes").select("session", F.col("event_id").alias("n"), F.create_map("h1", "v1", "h2", "v2").alias("headers"))
    return requests.header_union(rows, ["session"])


@query(f"""SELECT session, request_id, t0, CASE WHEN done IS NULL THEN 0 ELSE done - t0 END AS time, coalesce(status, 0) AS status,
           coalesce(size, 0) AS size FROM ({LIFE}) q""")
def har_entries(spark, folder):
    from textloom.sources.writers import har_entries as entries

    rows = entries(events.request_lifecycle(network(spark, folder)))
    get = lambda p: F.get_json_object("entry", p).cast("bigint")
    return rows.select("session", "request_id", "t0", get("$.time").alias("time"), get("$.response.status").alias("status"), get("$.response.content.size").alias("size"))
