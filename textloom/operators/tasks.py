"""Agent tasks and their messages: listing, token budgets, demotion, tool calls, run statistics.

``tasks``: project, id, title, goal, parent_id, started, ended, tier, summary, position, is_current.
``messages``: project, task_id, pos, kind, role, content, tool_name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.folding import INVISIBLE, WHITE
from textloom.functions.text import clip, estimate_tokens
from textloom.operators.ordered import ROWS_PER_SLICE, ordered_scan, slices
from textloom.session import cut_lineage

# Token budgets of tiers 1 and 2, and how far above them demotion starts.
TIER_1_BUDGET = 12000
TIER_2_BUDGET = 8000
HIGH_MARK = 1.10
LOW_MARK = 0.90
PROMPT_OVERHEAD = 1600
LIGHT = ("project", "id", "title", "goal", "parent_id", "started", "ended", "tier", "summary")


def list_tasks(tasks: DataFrame, parent: str | None = None, tier: int | None = None) -> DataFrame:
    out = tasks if parent is None else tasks.where(F.col("parent_id") == parent)
    return (out if tier is None else out.where(F.col("tier") == tier)).select(*LIGHT)


def search_tasks(tasks: DataFrame, query: str = "") -> DataFrame:
    """Tasks whose title, goal or summary holds ``query`` in any case; all tasks for an empty query."""
    filled = [F.when(F.col(c) != "", F.col(c)) for c in ("title", "goal", "summary")]
    return tasks.where(F.contains(F.lower(F.concat_ws(" ", *filled)), F.lit(query.lower()))).select(*LIGHT)


def message_tokens(messages: DataFrame) -> DataFrame:
    """Tokens per task: of all messages, of tool results alone, and of the notes that would stand for these."""
    of_results = lambda text: F.sum(F.when(F.col("kind") == "tool-result", estimate_tokens(text)).otherwise(0))
    return messages.groupBy("project", "task_id").agg(
        F.sum(estimate_tokens(F.col("content"))).alias("tokens"),
        of_results(F.col("content")).alias("result_tokens"),
        of_results(result_note()).alias("note_tokens"),
    )


def _with_tokens(tasks: DataFrame, messages: DataFrame) -> DataFrame:
    sums = message_tokens(messages).withColumnRenamed("task_id", "id")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("tokens", "result_tokens", "note_tokens")}
    return tasks.join(sums, ["project", "id"], "left").withColumns(zero)


def tokens_by_tier(tasks: DataFrame, messages: DataFrame) -> DataFrame:
    """Message tokens of tiers 1 and 2, summary tokens of tiers 3 and 4."""
    used = F.when(F.col("tier") >= 3, estimate_tokens(F.col("summary"))).otherwise(F.col("tokens"))
    return _with_tokens(tasks, messages).groupBy("project", "tier").agg(F.sum(used).alias("tokens"))


def result_note() -> Column:
    """A one-line note on the size of a tool result."""
    lines = F.size(F.split(F.coalesce("content", F.lit("")), "\n", -1))
    name = F.when(F.coalesce("tool_name", F.lit("")) == "", F.lit("tool")).otherwise(F.col("tool_name"))
    return F.format_string("[%s %s -> %d lines, masked]", "task_id", name, lines)


def mask_tool_results(messages: DataFrame) -> DataFrame:
    """Tool results replaced by a one-line note on their size."""
    return messages.withColumn("content", F.when(F.col("kind") == "tool-result", result_note()).otherwise(F.col("content")))


def _demoted(candidates: DataFrame, total: DataFrame, removed: str, budget: int, low_mark: bool, rows_per_slice: int) -> DataFrame:
    """The oldest finished tasks, for as long as what remains is above the high mark.

    What was removed before a task is a running sum, so one pass over the ordered candidates decides all of them.
    """
    cut = slices(candidates, ["project"], ["ended", "position"], rows_per_slice)
    run = ordered_scan(candidates, ["project"], ["ended", "position"], cut, sums={"_removed": F.col(removed)})
    left = F.col("_total") - (F.col("_removed") - F.col(removed))
    keep = left > HIGH_MARK * budget
    if low_mark:
        keep = keep & ((F.col("_removed") == F.col(removed)) | (left >= LOW_MARK * budget))
    return run.join(total, "project").where(keep)


def demote_tiers(
    tasks: DataFrame, messages: DataFrame, low_mark: bool = False, rows_per_slice: int = ROWS_PER_SLICE
) -> tuple[DataFrame, DataFrame]:
    """Tasks and messages after one round of demotion in every project.

    Tier 1 tasks get their tool results masked and become tier 2; then tier 2 tasks lose their messages and become tier 3.
    The oldest finished task goes first; the current one and unfinished ones stay.
    """
    # One pass over the messages gives every sum that either round needs; both rounds then work on tasks alone.
    sized = cut_lineage(_with_tokens(tasks, messages))
    free = F.col("ended").isNotNull() & ~F.col("is_current")
    one = sized.where(F.col("tier") == 1)
    total_1 = one.where(~F.col("is_current")).groupBy("project").agg(F.sum("tokens").alias("_total"))
    down_1 = _demoted(one.where(free), total_1, "result_tokens", TIER_1_BUDGET, low_mark, rows_per_slice)
    flag_1 = down_1.select("project", "id", F.lit(True).alias("_masked"))
    masked = F.coalesce("_masked", F.lit(False))
    stage = cut_lineage(
        sized.join(flag_1, ["project", "id"], "left").withColumns(
            {
                "tier": F.when(masked, 2).otherwise(F.col("tier")),
                "tokens": F.when(masked, F.col("tokens") - F.col("result_tokens") + F.col("note_tokens")).otherwise(F.col("tokens")),
                "_masked": masked,
            }
        )
    )

    two = stage.where(F.col("tier") == 2)
    total_2 = two.groupBy("project").agg(F.sum("tokens").alias("_total"))
    down_2 = _demoted(two.where(free), total_2, "tokens", TIER_2_BUDGET, low_mark, rows_per_slice)
    flag_2 = down_2.select("project", "id", F.lit(True).alias("_dropped"))

    dropped = F.col("_dropped")
    summary = F.when(dropped & (F.coalesce("summary", F.lit("")) == ""), F.lit("(no summary)")).otherwise(F.col("summary"))
    final = cut_lineage(
        stage.join(flag_2, ["project", "id"], "left").withColumns({"summary": summary, "tier": F.when(dropped, 3).otherwise(F.col("tier"))})
    )
    marks = final.where("_masked OR _dropped").select("project", F.col("id").alias("task_id"), "_masked", F.coalesce("_dropped", F.lit(False)).alias("_dropped"))
    marked = messages.join(marks, ["project", "task_id"], "left").where("NOT coalesce(_dropped, false)")
    text = F.when(F.col("_masked") & (F.col("kind") == "tool-result"), result_note()).otherwise(F.col("content"))
    return final.select(*tasks.columns), marked.withColumn("content", text).select(*messages.columns)


def rebuild_context(tasks: DataFrame, messages: DataFrame) -> DataFrame:
    """The message list a model is given: one summary row for tiers 3 and 4, else the messages; ordered by (position, pos)."""
    title = F.replace(F.col("title"), F.lit('"'), F.lit("&quot;"))
    body = F.when(F.coalesce("summary", F.lit("")) == "", F.lit("(no summary)")).otherwise(F.col("summary"))
    head = F.format_string(
        '<task-history id="%s" title="%s" parent="%s" status="%s">\n%s\n</task-history>',
        "id", title, F.coalesce("parent_id", F.lit("root")), F.when(F.col("ended").isNotNull(), "done").otherwise("open"), body,
    )
    closed = tasks.where(F.col("tier") >= 3).select("project", "position", F.lit(0).alias("pos"), F.lit("user").alias("role"), head.alias("content"))
    opened = tasks.where(F.col("tier") < 3).select("project", F.col("id").alias("task_id"), "position")
    said = messages.join(opened, ["project", "task_id"]).select("project", "position", "pos", "role", "content")
    return closed.unionByName(said)


def task_durations(tasks: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Duration of each finished task and the sibling that followed it."""
    siblings = tasks.withColumn("_order", -F.col("started")).withColumn("_back", -F.col("position"))
    out = ordered_scan(siblings, ["project", "parent_id"], ["_order", "_back"], slices(siblings, ["project", "parent_id"], ["_order", "_back"], rows_per_slice), previous={"next_sibling": F.col("id")})
    return out.select("project", "id", "parent_id", (F.col("ended") - F.col("started")).alias("duration_ms"), "next_sibling")


def parallelism_stats(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many tool calls the turns of the runs carried. ``runs`` has ``batches``, the calls per turn."""
    size = F.col("batch")
    rows = runs.select(*keys, F.posexplode_outer("batches").alias("_i", "batch"))
    first = F.count_if(F.coalesce(F.col("_i"), F.lit(0)) == 0)
    return rows.groupBy(*keys).agg(
        first.alias("runs"),
        F.count(size).alias("turns_with_tools"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total_tool_calls"),
        F.coalesce(F.round(F.avg(size), 2), F.lit(0.0)).alias("avg_per_turn"),
        F.coalesce(F.max(size), F.lit(0)).cast("bigint").alias("max_parallel"),
        F.count_if(size == 1).alias("single_call_turns"),
        F.count_if(size > 1).alias("multi_call_turns"),
    )


def parallelism_verdict(stats: DataFrame) -> DataFrame:
    turns = F.col("turns_with_tools")
    verdict = (
        F.when(turns == 0, "none")
        .when(F.col("max_parallel") <= 1, "sequential")
        .when(F.col("multi_call_turns") < 0.25 * turns, "rare")
        .otherwise("batching")
    )
    return stats.withColumn("verdict", verdict)


def tool_histogram(calls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Calls that ran, by tool. ``calls`` comes from loop detection; looped calls did not run, task operations are no tools."""
    ran = calls.where(~F.col("looped") & (F.col("kind") == "tool"))
    return ran.groupBy(*keys, "verb").agg(F.count("*").alias("calls"))


def run_counts(calls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Turns, executed tool calls, task operations and loop breaks. Turns are counted in two steps."""
    looped, tool = F.col("looped"), F.col("kind") == "tool"
    per_turn = calls.groupBy(*keys, "turn").agg(
        F.count_if(~looped & tool).alias("tools"), F.count_if(~looped & ~tool).alias("tasks"), F.count_if(looped).alias("loops")
    )
    return per_turn.groupBy(*keys).agg(
        F.count("*").alias("turns"), F.sum("tools").alias("tool_calls"), F.sum("tasks").alias("task_ops"), F.sum("loops").alias("loop_breaks")
    )


# ── tool calls in assistant text ──────────────────────────────────────────────

# Verbs, the tools behind them, the end of the command block.
VERB_TOOLS = {
    "list": "list_dir",
    "read": "read_file",
    "search": "grep",
    "find": "glob",
    "info": "file_info",
    "write": "write_file",
    "edit": "edit_file",
}
TASK_VERBS = ("next-task", "list-tasks", "task-detail", "search-tasks")
CUT = r"(?i)</remote-workspace>|<remote-workspace-result|<workspace-result"
BLOCK = r"(?i)<remote-workspace"
INTEGERS = {"read": ("offset", "limit")}

CALLS = T.ArrayType(
    T.StructType(
        [
            T.StructField("verb", T.StringType()),
            T.StructField("kind", T.StringType()),
            T.StructField("tool", T.StringType()),
            T.StructField("args", T.MapType(T.StringType(), T.StringType())),
        ]
    )
)


_VERBS = "|".join(sorted([*VERB_TOOLS, *TASK_VERBS], key=len, reverse=True))
_GAP = f"[{WHITE}{INVISIBLE[-1]}]"
_TAG = re.compile(rf"(?i)<(?P<verb>{_VERBS})(?![A-Za-z0-9_])(?P<attributes>[^>]*?)(?P<alone>/?)>")
_ENDS = re.compile(f"</({_VERBS})>")
_ATTRIBUTE = re.compile(rf'([a-zA-Z_][a-zA-Z0-9_-]*){_GAP}*={_GAP}*"([^"]*)"')
_PARTS = {part: re.compile(rf"(?is)<{part}{_GAP}*>(.*?)</{part}>") for part in ("find", "replace")}


def call_args(verb: str, attributes: str, body: str | None) -> dict[str, str]:
    """The attributes of a call, whole numbers in plain form, and what its body adds."""
    args = {name: value.strip(WHITE + INVISIBLE[-1]) for name, value in _ATTRIBUTE.findall(attributes)}
    whole = [n for n in INTEGERS.get(verb, ()) if re.fullmatch("[+-]?[0-9]+", args.get(n, ""))]
    args |= {n: str(int(args[n])) for n in whole}
    if body is None:
        return args
    held = {"write": lambda: {"content": body}, "edit": lambda: {n: m[1] for n, p in _PARTS.items() if (m := p.search(body))}}
    return args | held.get(verb, dict)()


def parse_calls(text: str | None) -> list[dict]:
    """The calls in one reply, in order.

    All tags and all ends are listed first. A tag's body reaches to the next end of its verb, and tags inside a body are part of it.
    """
    scan = re.split(CUT, text or "", maxsplit=1)[0]
    ends: dict[str, list[int]] = {}
    for m in _ENDS.finditer(scan):
        ends.setdefault(m[1], []).append(m.start())
    calls, free = [], 0
    for tag in _TAG.finditer(scan):
        if tag.start() < free:
            continue
        verb, free = tag["verb"].lower(), tag.end()
        own = ends.get(verb, ())
        at = bisect_left(own, free)
        body = None
        if not tag["alone"] and at < len(own):
            body, free = scan[free : own[at]], own[at] + len(f"</{verb}>")
        tool = VERB_TOOLS.get(verb)
        calls.append({"verb": verb, "kind": "tool" if tool else "task-op", "tool": tool, "args": call_args(verb, tag["attributes"], body)})
    return calls


@F.pandas_udf(CALLS)
def tool_calls_in(texts: pd.Series) -> pd.Series:
    return texts.map(parse_calls)


def extract_tool_calls(messages: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per call in the assistant texts, with its number in the text. Texts without a tag skip the parser."""
    tagged = messages.where(F.col(text).rlike("(?i)<(" + "|".join([*VERB_TOOLS, *TASK_VERBS]) + r")\b"))
    calls = tagged.select(*keys, F.posexplode(tool_calls_in(F.col(text))).alias("call", "c"))
    return calls.select(*keys, (F.col("call") + 1).alias("call"), "c.verb", "c.kind", "c.tool", "c.args")


def split_prose_and_commands(df: DataFrame, text: str = "text") -> DataFrame:
    """``prose`` before the first command block, ``commands`` from there on."""
    prose = F.split(F.col(text), BLOCK, 2)[0]
    return df.withColumn("prose", prose).withColumn("commands", F.substr(F.col(text), F.length("prose") + 1, F.length(text)))


def render_tool_results(calls: DataFrame, keys: Sequence[str], order: str = "call") -> DataFrame:
    """The result blocks of one turn as the text that is sent back. ``calls`` has verb, status, content."""
    block = F.format_string('<remote-workspace-result op="%s" status="%s">\n%s\n</remote-workspace-result>', "verb", "status", "content")
    closing = "\n\nUse these results to continue, or answer the user if you have enough information."
    blocks = F.transform(F.array_sort(F.collect_list(F.struct(order, block.alias("b")))), lambda x: x["b"])
    return calls.groupBy(*keys).agg(F.concat(F.array_join(blocks, "\n"), F.lit(closing)).alias("text"))


# ── conversations and streamed replies ────────────────────────────────────────


def prompt_token_estimate(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg((F.lit(PROMPT_OVERHEAD) + F.sum(estimate_tokens(F.col("text")))).alias("tokens"))


def last_user_message(turns: DataFrame) -> DataFrame:
    said = turns.where(F.col("role") == "user").groupBy("conv_id")
    return said.agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def render_prompt(turns: DataFrame) -> DataFrame:
    """The whole conversation as one prompt. A prompt is one string, so a conversation is bounded by what one may hold."""
    head = "Generate the next assistant message to be appended to this conversation.\n\n"
    tail = "[ASSISTANT]\n\n[your generated message will go here]"
    role = F.when(F.col("role") == "assistant", F.lit("[ASSISTANT]\n\n")).otherwise(F.lit("[USER]\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(role, "text", F.lit("\n\n")).alias("part"))))
    text = F.concat(F.lit(head), F.array_join(F.transform(parts, lambda p: p["part"]), ""), F.lit(tail))
    return turns.groupBy("conv_id").agg(text.alias("prompt"))


def assemble_stream(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reply text, first usage and last finish reason of every streamed response (pos, delta, total_tokens, finish_reason)."""
    parts = F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("pos", "delta"))))
    return chunks.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda p: p["delta"]), "").alias("text"),
        F.min_by("total_tokens", F.when(F.col("total_tokens").isNotNull(), F.col("pos"))).alias("total_tokens"),
        F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("pos"))).alias("finish_reason"),
    )


def usage_totals(chunks: DataFrame, keys: Sequence[str], response: Sequence[str]) -> DataFrame:
    """Tokens per key: of each response the first usage counts, then they are added up."""
    first = F.min_by("total_tokens", F.when(F.col("total_tokens").isNotNull(), F.col("pos")))
    per_response = chunks.groupBy(*keys, *response).agg(first.alias("tokens"))
    return per_response.groupBy(*keys).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"), F.count("tokens").alias("responses")
    )


def clip_texts(df: DataFrame, text: str = "text", n: int | None = None) -> DataFrame:
    return df.withColumn(text, clip(F.col(text)) if n is None else clip(F.col(text), n))
