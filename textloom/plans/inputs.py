"""Inputs of the registered queries, derived from the given tables by plain SQL.

The same text runs on Spark and on the checking engine. ``$name`` stands for another input or a table, ``@ms`` for
the epoch milliseconds of ``ts``, ``@each(...)`` for one row per listed value.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

INPUTS = {
    "ev": """
        SELECT CAST(user_id AS STRING) AS session, user_id, event_id, @ms AS t, event_type, value, props,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
        FROM $events""",
    "console": """
        SELECT session, event_id, t, props AS text,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'log' WHEN 'click' THEN 'info'
                    WHEN 'signup' THEN 'warning' ELSE 'warn' END AS level
        FROM $ev""",
    "network": """
        SELECT session, event_id, t, 'r' || CAST(k % 10 AS STRING) AS request_id,
               CASE event_type WHEN 'view' THEN 'response' WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed'
                    ELSE 'sent' END AS event,
               CASE WHEN k % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
               'https://api.wall.test/' || event_type || '/' || CAST(k AS STRING) AS url,
               CASE WHEN k % 5 = 0 THEN 404 WHEN k % 7 = 0 THEN 500 ELSE 200 END AS status,
               CASE WHEN k % 2 = 0 THEN 'application/json' ELSE 'text/html' END AS mime,
               CAST(floor(value * 100) AS BIGINT) AS size,
               'net::ERR_' || CAST(k % 4 AS STRING) AS error
        FROM $ev""",
    "calls": """
        SELECT session, event_id, t, CAST(floor(t / 3600000) AS BIGINT) AS turn,
               CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'list' WHEN 'purchase' THEN 'write'
                    WHEN 'signup' THEN 'next-task' ELSE 'search' END AS verb,
               CASE WHEN event_type = 'signup' THEN 'task-op' ELSE 'tool' END AS kind,
               '{"path":"f' || CAST(k % 2 AS STRING) || '"}' AS args
        FROM $ev""",
    "actions": """
        SELECT session, event_id, t,
               CASE WHEN event_type = 'click' THEN 'click #b' ELSE 'navigate /p' END || CAST(k AS STRING) AS action
        FROM $ev WHERE event_type IN ('click', 'signup')""",
    "changes": """
        SELECT session, event_id, t, 'div#n' || CAST(k AS STRING) AS node, k
        FROM $ev WHERE event_type NOT IN ('click', 'signup')""",
    "captured": """
        SELECT session, event_id, t, chat AS response_id, CASE WHEN event_type = 'signup' THEN 'new' ELSE 'chat' END AS kind,
               CASE event_type WHEN 'signup' THEN 'https://chat.wall.test/api/v1/chats/new'
                    WHEN 'click' THEN 'https://chat.wall.test/api/v1/chats/' || chat
                    WHEN 'view' THEN 'https://chat.wall.test/api/chat/completions'
                    WHEN 'purchase' THEN 'https://chat.wall.test/api/chat/completed'
                    ELSE 'https://chat.wall.test/api/v1/chats/' || chat || '?page=' || CAST(k AS STRING) END AS url,
               '{"chat_id":"' || chat || '","k":' || CAST(k AS STRING) || '}' AS body
        FROM (SELECT *, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4)
                        || '-' || substr(m, 21, 12) AS chat
              FROM (SELECT *, md5(session || '/' || CAST(CAST(floor(t / 432000000) AS BIGINT) AS STRING)) AS m FROM $ev) x) y""",
    "applog": """
        SELECT 'app' || CAST(user_id % 5 AS STRING) AS app, event_id, t, 'ev.' || event_type AS logger,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'INFO' WHEN 'click' THEN 'DEBUG'
                    WHEN 'signup' THEN 'WARN' ELSE 'TRACE' END AS level,
               'value ' || CAST(k AS STRING) || ' of user ' || session AS message
        FROM $ev""",
    "failures": """
        SELECT event_id, CASE k % 9 WHEN 0 THEN 'no system Java compiler found' WHEN 1 THEN 'library-ref shared' || session || ' did not resolve to any jar'
               WHEN 2 THEN 'bad url ${db.host' || CAST(k AS STRING) || '} in context' WHEN 3 THEN 'Hikari pool ' || session || ' could not connect'
               WHEN 4 THEN 'ClassCastException: org.springframework.X' WHEN 5 THEN 'COMPILE FAILED Foo.java:' || CAST(k AS STRING)
               WHEN 6 THEN 'generated class A' || CAST(k AS STRING) || ' is absent' ELSE 'socket closed ' || props END AS raw
        FROM $ev""",
    "probes": """
        SELECT session, event_id, 1 + k % 6 AS n, CASE WHEN event_type = 'click' AND k % 3 = 0 THEN 'good' ELSE 'bad' END AS verdict,
               'x-ratelimit-' || event_type AS h1, CAST(k AS STRING) AS v1, 'content-type' AS h2, event_type AS v2
        FROM $ev""",
    "task_rows": """
        SELECT CAST(conv_id % 2 AS STRING) AS project, 'T-' || CAST(conv_id AS STRING) AS id,
               first_text AS title, 'goal ' || CAST(conv_id % 17 AS STRING) AS goal,
               CASE WHEN conv_id < 10 THEN NULL ELSE 'T-' || CAST(conv_id % 10 AS STRING) END AS parent_id,
               1717180000000 + conv_id * 60000 AS started,
               CASE WHEN conv_id % 11 = 0 THEN NULL ELSE 1717180000000 + conv_id * 60000 + n * 1000 + (conv_id % 13) * 90000 END AS ended,
               CASE WHEN conv_id % 8 < 5 THEN 1 WHEN conv_id % 8 < 7 THEN 2 ELSE 3 + CAST(conv_id % 2 AS INT) END AS tier,
               CASE WHEN conv_id % 3 = 0 THEN NULL ELSE first_text END AS summary,
               conv_id AS position, conv_id % 29 = 0 AS is_current
        FROM (SELECT conv_id, count(*) AS n, min_by(text, turn) AS first_text FROM $conversations GROUP BY conv_id) c""",
    "task_messages": """
        SELECT CAST(conv_id % 2 AS STRING) AS project, 'T-' || CAST(conv_id AS STRING) AS task_id, turn AS pos,
               CASE WHEN role = 'user' AND turn > 0 THEN 'tool-result' ELSE 'assistant' END AS kind, role, text AS content,
               CASE turn % 3 WHEN 0 THEN 'grep' WHEN 1 THEN 'read_file' ELSE NULL END AS tool_name
        FROM $conversations""",
    "corpus": """
        SELECT source || '/' || lang || '/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 4 = 0 THEN '.md' ELSE '.txt' END AS path,
               doc_id, text, source, lang
        FROM $documents""",
    "paths": """
        SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM $pages""",
    "routes": """
        SELECT DISTINCT pattern, pattern AS route FROM (
            SELECT path AS pattern FROM $paths WHERE page_id % 10 = 0
            UNION ALL SELECT '/' || regexp_extract(path, '^/([a-z]+)/', 1) || '/*' FROM $paths WHERE page_id % 3 = 0
            UNION ALL SELECT '*.html' FROM $paths
        ) r""",
    "store": """
        SELECT 'n' || CAST(c_nationkey AS STRING) AS family, 'c' || CAST(c_custkey AS STRING) AS member, p.path,
               CASE p.path WHEN 'name' THEN c_name
                    WHEN 'phone' THEN '555-' || lpad(CAST(c_custkey AS STRING), 7, '0')
                    WHEN 'address.city' THEN 'Town ' || CAST(c_custkey % 50 AS STRING) || 'x'
                    WHEN 'nick' THEN 'Nick' || CAST(c_custkey AS STRING) || 'y'
                    WHEN 'alias' THEN 'NICK' || CAST(c_custkey AS STRING) || 'Y'
                    WHEN 'floor' THEN CAST(c_custkey % 90 AS STRING)
                    ELSE c_mktsegment END AS value
        FROM (SELECT *, @each('name', 'phone', 'address.city', 'nick', 'alias', 'floor', 'segment') AS path FROM $customer) p
        UNION ALL
        SELECT 'n' || CAST(n_nationkey AS STRING), NULL, 'deers_family_id', '7000' || lpad(CAST(n_nationkey AS STRING), 3, '0') FROM $nation""",
    "letters": """
        SELECT o_orderkey AS doc_id, o_orderpriority AS source,
               'Order for customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') || ', tel (555) ' || lpad(CAST(o_custkey AS STRING), 7, '0')
               || ', town ' || CAST(o_custkey % 50 AS STRING) || 'X; called nick' || CAST(o_custkey AS STRING) || 'y - not nick'
               || CAST(o_custkey AS STRING) || 'yz.' AS text
        FROM $orders""",
}


def _expand(text: str, table, ms: str, each: str) -> str:
    def sub(m: re.Match) -> str:
        name = m.group(1)
        return table(name) if name in TABLES else f"({_expand(INPUTS[name], table, ms, each)})" if name in INPUTS else m.group(0)

    text = re.sub(r"@each\(([^)]*)\)", each, text.replace("@ms", ms))
    return re.sub(r"\$([a-z_]+)", sub, text)


def check_sql(text: str) -> str:
    """``text`` with inputs in place, for the checking engine."""
    return _expand(text, lambda name: name, "epoch_us(ts) // 1000", r"unnest([\1])").strip()


def load(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """An input by name, or SQL over inputs, as a Spark frame."""
    sql = f"SELECT * FROM ${text}" if re.fullmatch("[a-z_]+", text) else text
    return spark.sql(_expand(sql, lambda name: f"parquet.`{folder}/{name}.parquet`", "unix_millis(CAST(ts AS TIMESTAMP))", r"explode(array(\1))"))
