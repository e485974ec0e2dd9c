"""Queries over tasks, messages, tool calls and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import events, tasks
from textloom.plans.catalog import query
from textloom.plans.events_queries import LOOPS
from textloom.plans.inputs import load
from textloom.sources.readers import chunk_fields, response_parts, sse_chunks

_TOK = "CAST(ceil(length(coalesce({0}, '')) / 4.0) AS BIGINT)"


def rows(spark, folder):
    return load(spark, folder, "task_rows"), load(spark, folder, "task_messages")


def calls(spark, folder):
    return events.detect_loops(load(spark, folder, "calls"))


@query(f"""SELECT project, tier, CAST(sum(CASE WHEN tier >= 3 THEN {_TOK.format('summary')} ELSE coalesce(m.n, 0) END) AS BIGINT) AS tokens
           FROM $task_rows t LEFT JOIN (SELECT project, task_id AS id, sum({_TOK.format('content')}) AS n FROM $task_messages GROUP BY ALL) m
           USING (project, id) GROUP BY project, tier""")
def tokens_by_tier(spark, folder):
    return tasks.tokens_by_tier(*rows(spark, folder))


_LIGHT = "project, id, title, goal, parent_id, started, ended, tier, summary"


@query(f"SELECT {_LIGHT} FROM $task_rows WHERE parent_id = 'T-3' AND tier = 1")
def list_tasks(spark, folder):
    return tasks.list_tasks(rows(spark, folder)[0], "T-3", 1)


@query(f"SELECT {_LIGHT} FROM $task_rows WHERE contains(lower(concat_ws(' ', title, goal, summary)), 'goal 1')")
def search_tasks(spark, folder):
    return tasks.search_tasks(rows(spark, folder)[0], "GOAL 1")


DEMOTED = f"""
    WITH s AS (SELECT project, task_id AS id, sum({_TOK.format('content')}) AS n,
                      sum(CASE WHEN kind = 'tool-result' THEN {_TOK.format('content')} ELSE 0 END) AS r FROM $task_messages GROUP BY ALL),
    a AS (SELECT t.*, coalesce(n, 0) AS n, coalesce(r, 0) AS r FROM $task_rows t LEFT JOIN s USING (project, id)),
    t1 AS (SELECT project, sum(n) AS total FROM a WHERE tier = 1 AND NOT is_current GROUP BY project),
    c1 AS (SELECT a.*, total - (sum(r) OVER (PARTITION BY a.project ORDER BY ended, position) - r) AS remaining
           FROM a JOIN t1 USING (project) WHERE tier = 1 AND NOT is_current AND ended IS NOT NULL),
    d1 AS (SELECT project, id FROM c1 WHERE remaining > 1.1 * 12000),
    m AS (SELECT x.* EXCLUDE (content), CASE WHEN d1.id IS NOT NULL AND kind = 'tool-result' THEN '[' || task_id || ' ' || coalesce(tool_name, 'tool')
                 || ' -> ' || len(string_split(content, chr(10))) || ' lines, masked]' ELSE content END AS content
          FROM $task_messages x LEFT JOIN d1 ON d1.project = x.project AND d1.id = x.task_id),
    b AS (SELECT t.* EXCLUDE (tier), CASE WHEN d1.id IS NOT NULL THEN 2 ELSE tier END AS tier, coalesce(k.n, 0) AS n
          FROM $task_rows t LEFT JOIN d1 USING (project, id)
          LEFT JOIN (SELECT project, task_id AS id, sum({_TOK.format('content')}) AS n FROM m GROUP BY ALL) k USING (project, id)),
    t2 AS (SELECT project, sum(n) AS total FROM b WHERE tier = 2 GROUP BY project),
    d2 AS (SELECT project, id FROM (SELECT b.*, total - (sum(n) OVER (PARTITION BY b.project ORDER BY ended, position) - n) AS remaining
           FROM b JOIN t2 USING (project) WHERE tier = 2 AND NOT is_current AND ended IS NOT NULL) z WHERE remaining > 1.1 * 8000)
"""


@query(f"""{DEMOTED} SELECT b.project, b.id, CASE WHEN d2.id IS NOT NULL THEN 3 ELSE b.tier END AS tier,
           CASE WHEN d2.id IS NOT NULL THEN coalesce(b.summary, '(no summary)') ELSE b.summary END AS summary
           FROM b LEFT JOIN d2 USING (project, id)""")
def demote_tiers(spark, folder):
    return tasks.demote_tiers(*rows(spark, folder))[0].select("project", "id", "tier", "summary")


@query(f"""{DEMOTED} SELECT m.project, m.task_id, m.pos, m.content FROM m LEFT JOIN d2 ON d2.project = m.project AND d2.id = m.task_id WHERE d2.id IS NULL""")
def demoted_messages(spark, folder):
    return tasks.demote_tiers(*rows(spark, folder))[1].select("project", "task_id", "pos", "content")


@query("""SELECT project, task_id, pos, CASE WHEN kind = 'tool-result' THEN '[' || task_id || ' ' || coalesce(tool_name, 'tool') || ' -> '
          || len(string_split(content, chr(10))) || ' lines, masked]' ELSE content END AS content FROM $task_messages""")
def mask_tool_results(spark, folder):
    return tasks.mask_tool_results(rows(spark, folder)[1]).select("project", "task_id", "pos", "content")


@query("""SELECT project, position, 0 AS pos, 'user' AS role, '<task-history id="' || id || '" title="' || replace(title, '"', '&quot;') || '" parent="'
            || coalesce(parent_id, 'root') || '" status="' || CASE WHEN ended IS NULL THEN 'open' ELSE 'done' END || '">' || chr(10)
            || coalesce(summary, '(no summary)') || chr(10) || '</task-history>' AS content FROM $task_rows WHERE tier >= 3
          UNION ALL SELECT m.project, t.position, m.pos, m.role, m.content FROM $task_messages m JOIN $task_rows t
            ON t.project = m.project AND t.id = m.task_id WHERE t.tier < 3""")
def rebuild_context(spark, folder):
    return tasks.rebuild_context(*rows(spark, folder))


@query("""SELECT project, id, ended - started AS duration_ms, lead(id) OVER (PARTITION BY project, parent_id ORDER BY started, position) AS next_sibling
          FROM $task_rows""")
def task_durations(spark, folder):
    return tasks.task_durations(rows(spark, folder)[0]).drop("parent_id")


def runs(spark, folder):
    turns = load(spark, folder, "SELECT session, turn, count(*) AS n FROM $calls GROUP BY session, turn")
    # A run is a day of a session, so its list of turns has at most 24 entries.
    return turns.groupBy("session", F.floor(F.col("turn") / 24).alias("day")).agg(F.collect_list("n").alias("batches"))


_BATCH = "SELECT session, floor(turn / 24) AS day, count(*) AS n FROM $calls GROUP BY session, turn"
_STATS = f"""SELECT session, count(DISTINCT day) AS runs, count(*) AS turns_with_tools, CAST(sum(n) AS BIGINT) AS total_tool_calls,
    round(avg(n), 2) AS avg_per_turn, max(n) AS max_parallel, count(*) FILTER (n = 1) AS single_call_turns, count(*) FILTER (n > 1) AS multi_call_turns
    FROM ({_BATCH}) b GROUP BY session"""


@query(_STATS)
def parallelism_stats(spark, folder):
    return tasks.parallelism_stats(runs(spark, folder), ["session"])


@query(f"""SELECT session, CASE WHEN turns_with_tools = 0 THEN 'none' WHEN max_parallel <= 1 THEN 'sequential'
           WHEN multi_call_turns * 4 < turns_with_tools THEN 'rare' ELSE 'batching' END AS verdict FROM ({_STATS}) s""")
def parallelism_verdict(spark, folder):
    return tasks.parallelism_verdict(tasks.parallelism_stats(runs(spark, folder), ["session"])).select("session", "verdict")


@query(f"SELECT session, verb, count(*) AS calls FROM ({LOOPS}) z WHERE kind = 'tool' AND repeat < 3 GROUP BY session, verb")
def tool_histogram(spark, folder):
    return tasks.tool_histogram(calls(spark, folder), ["session"])


@query(f"""SELECT session, count(DISTINCT turn) AS turns, count(*) FILTER (kind = 'tool' AND repeat < 3) AS tool_calls,
           count(*) FILTER (kind <> 'tool' AND repeat < 3) AS task_ops, count(*) FILTER (repeat >= 3) AS loop_breaks FROM ({LOOPS}) z GROUP BY session""")
def run_counts(spark, folder):
    return tasks.run_counts(calls(spark, folder), ["session"])


def chunks(spark, folder):
    """Every assistant turn as the words of a streamed reply, with usage notes here and there."""
    said = load(spark, folder, "SELECT conv_id, turn, text FROM $conversations WHERE role = 'assistant'")
    words = said.select("conv_id", "turn", F.posexplode(F.split("text", " ", -1)).alias("pos", "w"))
    return words.select(
        "conv_id", "turn", "pos", F.concat(F.when(F.col("pos") > 0, F.lit(" ")).otherwise(F.lit("")), "w").alias("delta"),
        F.when(F.col("pos") % 7 == 3, F.length("w") + F.col("conv_id")).alias("total_tokens"), F.lit("stop").alias("finish_reason"),
    )


_WORDS = "SELECT conv_id, turn, string_split(text, ' ') AS w FROM $conversations WHERE role = 'assistant'"


@query(f"SELECT c.conv_id, c.turn, c.text, CASE WHEN len(w) > 3 THEN length(w[4]) + c.conv_id END AS total_tokens, 'stop' AS finish_reason FROM $conversations c JOIN ({_WORDS}) x USING (conv_id, turn)")
def assemble_stream(spark, folder):
    return tasks.assemble_stream(chunks(spark, folder), ["conv_id", "turn"])


@query(f"""SELECT conv_id, coalesce(CAST(sum(CASE WHEN len(w) > 3 THEN length(w[4]) + conv_id END) AS BIGINT), 0) AS total_tokens,
           count(*) FILTER (len(w) > 3) AS responses FROM ({_WORDS}) x GROUP BY conv_id""")
def usage_totals(spark, folder):
    return tasks.usage_totals(chunks(spark, folder), ["conv_id"], ["turn"])


@query("SELECT conv_id, turn, text FROM $conversations WHERE role = 'assistant'")
def sse_reply_text(spark, folder):
    delta = F.struct(F.array(F.struct(F.struct(F.col("delta").alias("content")).alias("delta"))).alias("choices"))
    data = chunks(spark, folder).select("conv_id", "turn", (F.col("pos") * 2).alias("pos"), F.concat(F.lit("data: "), F.to_json(delta), F.lit("\r")).alias("line"))
    keys = ["conv_id", "turn"]
    noise = data.select(*keys, (F.col("pos") + 1).alias("pos"), F.lit(": keep-alive").alias("line"))
    ends = data.groupBy(*keys).agg(F.max("pos").alias("last"))
    done = ends.select(*keys, F.explode(F.array(F.struct((F.col("last") + 2).alias("pos"), F.lit("data: [DONE]").alias("line")), F.struct((F.col("last") + 3).alias("pos"), F.lit("data: {\"choices\":[{\"delta\":{\"content\":\"late\"}}]}").alias("line")))).alias("x")).select(*keys, "x.*")
    lines = data.unionByName(noise).unionByName(done)
    return tasks.assemble_stream(chunk_fields(sse_chunks(lines, keys), keys), keys).select(*keys, "text")


@query("""SELECT conv_id, trim(string_agg(text, '' ORDER BY turn), ' ' || chr(10) || chr(9) || chr(13)) AS reply FROM $conversations
          WHERE role = 'assistant' AND turn % 4 <> 3 GROUP BY conv_id""")
def assistant_reply_text(spark, folder):
    from textloom.functions.text import assistant_reply_text as reply_text

    said = load(spark, folder, "SELECT conv_id, turn, text FROM $conversations WHERE role = 'assistant'")
    content = F.struct(F.struct(F.col("text"), (F.col("turn") % 4 == 3).alias("thought")).alias("content"))
    one = F.struct(F.struct(F.struct(F.array(F.struct(content.alias("groundedContent"))).alias("replies")).alias("answer")).alias("streamAssistResponse"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("c")))), lambda x: x["c"])
    bodies = said.groupBy("conv_id").agg(F.concat(F.lit(')]}"\n'), F.to_json(parts)).alias("value"))
    replies = response_parts(bodies).select("conv_id", reply_text(F.col("chunks")).alias("reply"))
    return replies.where(F.col("reply") != "")


@query(f"SELECT conv_id, CAST(1600 + sum({_TOK.format('text')}) AS BIGINT) AS tokens FROM $conversations GROUP BY conv_id")
def prompt_token_estimate(spark, folder):
    return tasks.prompt_token_estimate(load(spark, folder, "SELECT * FROM $conversations"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM $conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, folder):
    return tasks.last_user_message(load(spark, folder, "SELECT * FROM $conversations"))


@query("""SELECT conv_id, 'Generate the next assistant message to be appended to this conversation.' || chr(10) || chr(10)
          || string_agg(CASE WHEN role = 'assistant' THEN '[ASSISTANT]' ELSE '[USER]' END || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn)
          || '[ASSISTANT]' || chr(10) || chr(10) || '[your generated message will go here]' AS prompt FROM $conversations GROUP BY conv_id""")
def render_prompt(spark, folder):
    return tasks.render_prompt(load(spark, folder, "SELECT * FROM $conversations"))


_TAGGED = """SELECT conv_id, turn, 'Look: ' || replace(substr(text, 1, 60), '<', ' ') || '<remote-workspace><read path="f' || CAST(conv_id AS STRING)
    || '.txt" offset="0' || CAST(turn AS STRING) || '"/><write path="o">' || text || '</write><next-task title="T' || CAST(turn AS STRING)
    || '"></remote-workspace><list/>' AS text FROM $conversations WHERE role = 'assistant'"""


@query(f"""SELECT conv_id, turn, c AS call, CASE c WHEN 1 THEN 'read' WHEN 2 THEN 'write' ELSE 'next-task' END AS verb,
           CASE c WHEN 3 THEN 'task-op' ELSE 'tool' END AS kind,
           CASE c WHEN 1 THEN 'f' || conv_id || '.txt/' || turn WHEN 2 THEN 'o/' || text ELSE 'T' || turn END AS args
           FROM $conversations, (SELECT unnest([1, 2, 3]) AS c) WHERE role = 'assistant'""")
def extract_tool_calls(spark, folder):
    found = tasks.extract_tool_calls(load(spark, folder, _TAGGED), ["conv_id", "turn"])
    a = lambda k: F.col("args")[k]
    args = F.when(F.col("verb") == "read", F.concat_ws("/", a("path"), a("offset"))).when(F.col("verb") == "write", F.concat_ws("/", a("path"), a("content"))).otherwise(a("title"))
    return found.select("conv_id", "turn", "call", "verb", "kind", args.alias("args"))


@query(f"""SELECT conv_id, turn, regexp_extract(text, '^(?s)(.*?)<remote-workspace', 1) AS prose,
           length(text) - length(regexp_extract(text, '^(?s)(.*?)<remote-workspace', 1)) AS rest FROM ({_TAGGED}) t""")
def split_prose_and_commands(spark, folder):
    return tasks.split_prose_and_commands(load(spark, folder, _TAGGED)).select("conv_id", "turn", "prose", F.length("commands").alias("rest"))


#: The same with the whole text as prose.
_TAGGED_WHOLE = _TAGGED.replace("substr(text, 1, 60)", "text")


@query(f"""SELECT conv_id, turn, c AS call, CASE c WHEN 1 THEN 'read' WHEN 2 THEN 'write' ELSE 'next-task' END AS verb,
           CASE c WHEN 3 THEN 'task-op' ELSE 'tool' END AS kind,
           CASE c WHEN 1 THEN 'f' || conv_id || '.txt/' || turn WHEN 2 THEN 'o/' || text ELSE 'T' || turn END AS args
           FROM $conversations, (SELECT unnest([1, 2, 3]) AS c) WHERE role = 'assistant'""")
def extract_tool_calls_whole(spark, folder):
    found = tasks.extract_tool_calls(load(spark, folder, _TAGGED_WHOLE), ["conv_id", "turn"])
    a = lambda k: F.col("args")[k]
    args = F.when(F.col("verb") == "read", F.concat_ws("/", a("path"), a("offset"))).when(F.col("verb") == "write", F.concat_ws("/", a("path"), a("content"))).otherwise(a("title"))
    return found.select("conv_id", "turn", "call", "verb", "kind", args.alias("args"))


@query(f"""SELECT conv_id, turn, regexp_extract(text, '^(?s)(.*?)<remote-workspace', 1) AS prose,
           length(text) - length(regexp_extract(text, '^(?s)(.*?)<remote-workspace', 1)) AS rest FROM ({_TAGGED_WHOLE}) t""")
def split_prose_and_commands_whole(spark, folder):
    return tasks.split_prose_and_commands(load(spark, folder, _TAGGED_WHOLE)).select("conv_id", "turn", "prose", F.length("commands").alias("rest"))


@query("""SELECT conv_id, string_agg('<remote-workspace-result op="read" status="' || CASE WHEN turn % 2 = 0 THEN 'ok' ELSE 'error' END || '">' || chr(10) || text
          || chr(10) || '</remote-workspace-result>', chr(10) ORDER BY turn) || chr(10) || chr(10)
          || 'Use these results to continue, or answer the user if you have enough information.' AS text FROM $conversations GROUP BY conv_id""")
def render_tool_results(spark, folder):
    rows = load(spark, folder, "SELECT conv_id, turn AS call, 'read' AS verb, CASE WHEN turn % 2 = 0 THEN 'ok' ELSE 'error' END AS status, text AS content FROM $conversations")
    return tasks.render_tool_results(rows, ["conv_id"])
