"""Captured requests: templates, replay plans, chat trees, tool round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ordered import ROWS_PER_SLICE, ordered_scan, slices
from textloom.session import cut_lineage

CHAT_ID = "${chat_id}"


def template_requests(df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, order: tuple[str, ...] = ("t", "event_id")) -> DataFrame:
    """Put a placeholder where a request names the chat opened last in its session.

    ``response_id`` is the id a new-chat response returned. Rows of kind ``new`` stay as they are.
    """
    new = F.col("kind") == "new"
    out = ordered_scan(df, ["session"], order, slices(df, ["session"], order, rows_per_slice), lasts={"chat_id": F.when(new, F.col("response_id"))})
    fill = lambda c: F.when(new | F.col("chat_id").isNull(), F.col(c)).otherwise(F.replace(F.col(c), F.col("chat_id"), F.lit(CHAT_ID)))
    return out.withColumns({"url": fill("url"), "body": fill("body"), "is_new_chat": new, "is_template": ~new})


def replay_plan(df: DataFrame, new_ids: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, order: tuple[str, ...] = ("t", "event_id")) -> DataFrame:
    """What a replay would send. Every new-chat request opens a group whose new id fills the templates after it.

    ``new_ids`` has (session, group, new_id). Nothing is sent.
    """
    grouped = ordered_scan(df, ["session"], order, slices(df, ["session"], order, rows_per_slice), sums={"group": F.col("is_new_chat").cast("bigint")})
    joined = grouped.join(new_ids.select("session", "group", "new_id"), ["session", "group"], "left")
    use = F.col("is_template") & F.col("new_id").isNotNull()
    fill = lambda c: F.when(use, F.replace(F.col(c), F.lit(CHAT_ID), F.col("new_id"))).otherwise(F.col(c))
    return joined.withColumns({"url": fill("url"), "body": fill("body")})


def chat_nodes(requests: DataFrame) -> DataFrame:
    """One row per message of the chat trees held in captured requests."""
    chat = F.col("options.body.chat")
    rows = requests.select("url", F.col("timestamp").alias("captured"), F.explode(chat["history"]["messages"]).alias("node", "m"))
    return rows.select(
        "url", "captured", "node", F.col("m.parentId").alias("parent_id"), F.col("m.childrenIds").alias("children"),
        F.col("m.role").alias("role"), F.col("m.content").alias("content"), chat_time_ms(F.col("m.timestamp")).alias("t"),
        F.coalesce(F.col("m.model"), F.get("m.models", F.lit(0))).alias("model"),
    )


def chat_time_ms(t: Column) -> Column:
    """Chat times come in seconds or in milliseconds; the size tells."""
    return F.when(t < 100_000_000_000, t * 1000).otherwise(t)


def thread_tree(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Root and depth of every node (tree, node, parent_id), by following parent pointers. An orphan is its own root.

    Pointers are doubled: each round an unfinished node takes over the pointer of the node it points to, so a thread of
    length n needs log2(n) joins. Whatever is unfinished after as many rounds as the number of nodes allows lies on a cycle or
    hangs from one, and gets NULL as its root; so does what ``max_depth``, if it is given, does not reach.
    """
    ids = nodes.select("tree", F.col("node").alias("parent_id"), F.col("node").alias("_up")).distinct()
    up = F.col("_up")
    linked = nodes.select("tree", "node", "parent_id").join(ids, ["tree", "parent_id"], "left")
    state = cut_lineage(
        linked.select("tree", "node", F.coalesce(up, "node").alias("root"), up.isNotNull().cast("bigint").alias("depth"), up.isNull().alias("done"))
    )
    reach, size = 1, state.count()
    while reach < (2 * size if max_depth is None else max_depth) and not state.where(~F.col("done")).isEmpty():
        above = state.select("tree", F.col("node").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        moved = state.where(~F.col("done")).join(above, ["tree", "root"])
        moved = moved.select("tree", "node", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        state = cut_lineage(state.where("done").unionByName(moved))
        reach *= 2
    return state.select("tree", "node", F.when(F.col("done"), F.col("root")).alias("root"), "depth")


def tool_flow(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and results by id: ``matched``, ``no_result`` or ``no_call``. Repeated ids count."""
    c = calls.groupBy("session", "call_id").agg(F.count("*").alias("calls"))
    r = results.groupBy("session", "call_id").agg(F.count("*").alias("results"))
    status = F.when(F.col("results").isNull(), "no_result").when(F.col("calls").isNull(), "no_call").otherwise("matched")
    return c.join(r, ["session", "call_id"], "full").select(
        "session", "call_id", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("results", F.lit(0)).alias("results"), status.alias("status")
    )


def probe_rollup(results: DataFrame, keys: list[str], total: int = 6) -> DataFrame:
    """The overall verdict of each group of probe results (n, verdict)."""
    good = F.col("verdict") == "good"
    first = F.coalesce(F.bool_or(good & F.col("n").isin(2, 3, 4)), F.lit(False))
    fifth = F.coalesce(F.bool_or(good & (F.col("n") == 5)), F.lit(False))
    short = F.format_string("incomplete (%d/" + str(total) + ")", F.count("*"))
    verdict = (
        F.when(first, F.lit("client tools work"))
        .when(fifth, F.lit("message tools work"))
        .when(F.count("*") < total, short)
        .otherwise(F.lit("no client tools"))
    )
    return results.groupBy(*keys).agg(verdict.alias("overall"))


# Fixed value: headers that tell about limits and use.
QUOTA_HEADERS = r"(?i)(ratelimit|rate-limit|retry-after|quota|x-request|x-goog|tokens?-remaining|tokens?-limit|usage)"


def header_union(results: DataFrame, keys: list[str]) -> DataFrame:
    """The interesting headers of all results; of equal names the last result's value."""
    rows = results.select(*keys, "n", F.explode("headers").alias("name", "value")).where(F.col("name").rlike(QUOTA_HEADERS))
    return rows.groupBy(*keys, "name").agg(F.max_by("value", F.struct("n", "value")).alias("value"))
