"""Session event logs: order, cursors, filters, request lifecycles, attribution.

Frames carry ``session``, a time in epoch milliseconds ``t`` and a tie-break column, named by ``order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.web import dom_change_summary, facts_change_summary, page_facts
from textloom.operators.ordered import ROWS_PER_SLICE, last_rows, ordered_scan, slices

# Limits.
BUFFER_ROWS = 500
DOM_ROWS = 200
TIMELINE_ROWS = 5000
QUIET_MS = 500
SETTLE_CAP_MS = 10_000
STALL_MS = 1500

ORDER = ("t", "event_id")


def sequence_events(df: DataFrame, order: Sequence[str] = ORDER, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``seq`` from 1 within every session."""
    return ordered_scan(df, ["session"], order, slices(df, ["session"], order, rows_per_slice), sums={"seq": F.lit(1).cast("bigint")})


def ring_buffer(
    df: DataFrame,
    n: int = BUFFER_ROWS,
    keys: Sequence[str] = ("session",),
    order: Sequence[str] = ORDER,
    oldest: int | None = None,
) -> DataFrame:
    """The last ``n`` rows per key, optionally none older than time ``oldest``."""
    recent = df if oldest is None else df.where(F.col("t") >= oldest)
    return last_rows(recent, keys, order, n)


def read_since(df: DataFrame, cursor: int) -> tuple[DataFrame, DataFrame]:
    """Rows after the cursor, and the next cursor: the highest ``seq`` there is."""
    return df.where(F.col("seq") > cursor), df.agg(F.coalesce(F.max("seq"), F.lit(cursor)).alias("cursor"))


def filter_console(df: DataFrame, level: str | None = None, since: int | None = None) -> DataFrame:
    """Lines of one level after a time. ``warning`` also takes ``warn``."""
    out = df
    if level is not None:
        out = out.where(F.col("level").isin("warning", "warn") if level == "warning" else F.col("level") == level)
    return out if since is None else out.where(F.col("t") > since)


def filter_network(df: DataFrame, contains: str | None = None, failed_only: bool = False) -> DataFrame:
    """Requests whose URL holds ``contains``; only transport failures and statuses from 400 on if asked."""
    out = df.where(F.col("failed").isNotNull() | (F.col("status") >= 400)) if failed_only else df
    return out if contains is None else out.where(F.contains(F.col("url"), F.lit(contains)))


def timeline(df: DataFrame, kind: str | None = None, since: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries in time order, and the new cursor: the latest time among them, or ``since`` if there are none."""
    out = df if kind is None else df.where(F.col("kind") == kind)
    out = out if since is None else out.where(F.col("t") > since)
    return out.orderBy("t"), out.agg(F.coalesce(F.max("t"), F.lit(since)).alias("cursor"))


def merge_timeline(**kinds: DataFrame) -> DataFrame:
    """One time-ordered table from several kinds of entries (session, t, text)."""
    parts = [df.select("session", "t", F.lit(kind).alias("kind"), "text") for kind, df in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("t")


def request_lifecycle(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per request from its sent / response / finished / failed events.

    Only events at or after the first ``sent`` count, and of each kind the last one does. Everything is an aggregate
    with partial results before the shuffle, so a busy request id is no bottleneck.
    """
    at = F.struct(*order)
    sent, answered, ended = F.col("event") == "sent", F.col("event") == "response", F.col("event").isin("finished", "failed")
    finished, failed = F.col("event") == "finished", F.col("event") == "failed"
    last = lambda value, when: F.max_by(F.struct(value.alias("v"), at.alias("at")), F.when(when, at))
    rows = df.groupBy("session", "request_id").agg(
        F.min(F.when(sent, at)).alias("first"),
        F.count_if(sent).alias("n_sent"),
        last(F.struct("url", "method"), sent).alias("sent"),
        last(F.struct("status", "mime"), answered).alias("answer"),
        last(F.col("t"), ended).alias("end"),
        last(F.col("size"), finished).alias("finish"),
        last(F.col("error"), failed).alias("failure"),
    )
    valid = lambda name, field: F.when(F.col(f"{name}.at") >= F.col("first"), F.col(f"{name}.v{field}"))
    done = valid("end", "")
    return rows.where(F.col("first").isNotNull()).select(
        "session",
        "request_id",
        F.col("sent.v.method").alias("method"),
        F.col("sent.v.url").alias("url"),
        F.col(f"first.{order[0]}").alias("t0"),
        valid("answer", ".status").alias("status"),
        valid("answer", ".mime").alias("mime"),
        done.alias("done"),
        valid("finish", "").alias("size"),
        valid("failure", "").alias("failed"),
        (F.col("n_sent") - 1).alias("redirects"),
        F.when(done.isNotNull(), done - F.col(f"first.{order[0]}")).alias("ms"),
    )


def collapse_redirects(df: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Last URL and method of each request id, and how often it was redirected."""
    at = F.struct(*order)
    sent = df.where(F.col("event") == "sent").groupBy("session", "request_id")
    return sent.agg(
        F.max_by("url", at).alias("url"), F.max_by("method", at).alias("method"), (F.count("*") - 1).alias("redirects")
    )


def attribute_changes(
    changes: DataFrame,
    actions: DataFrame,
    order: Sequence[str] = ORDER,
    drained: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``cause``: the latest action of the session at or before each change.

    ``drained`` names the latest action of the whole session instead, as a collector does that reads changes late.
    """
    if drained:
        latest = actions.groupBy("session").agg(F.max_by("action", F.struct(*order)).alias("cause"))
        return changes.join(latest, "session", "left")
    # The flag orders an action before a change that has the same position.
    both = actions.select("session", *order, "action", F.lit(0).alias("_change")).unionByName(
        changes.withColumn("action", F.lit(None).cast("string")).withColumn("_change", F.lit(1)), allowMissingColumns=True
    )
    cut = slices(both, ["session"], [*order, "_change"], rows_per_slice)
    scanned = ordered_scan(both, ["session"], [*order, "_change"], cut, lasts={"cause": F.col("action")})
    return scanned.where(F.col("_change") == 1).select(*changes.columns, "cause")


def describe_changes(df: DataFrame) -> DataFrame:
    """Add the one-line ``summary`` of added, removed and changed elements."""
    return df.withColumn("summary", dom_change_summary(F.col("added"), F.col("removed"), F.col("attr"), F.col("cause")))


def snapshot_diffs(df: DataFrame, order: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``summary``: each snapshot against the one before it in its session. What is compared are facts of the pages, taken as they are read."""
    facts = df.withColumn("_facts", page_facts(F.col("html")))
    out = ordered_scan(facts, ["session"], order, slices(df, ["session"], order, rows_per_slice), previous={"_before": F.col("_facts")})
    return out.withColumn("summary", facts_change_summary(F.col("_before"), F.col("_facts"))).drop("_before", "_facts")


def stall_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER, limit_ms: int = STALL_MS, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Rows that came more than ``limit_ms`` after the one before, with the gap."""
    out = ordered_scan(df, keys, order, slices(df, keys, order, rows_per_slice), previous={"_before": F.col(order[0])})
    return out.withColumn("gap_ms", F.col(order[0]) - F.col("_before")).where(F.col("gap_ms") > limit_ms).drop("_before")


def settle_windows(df: DataFrame, quiet_ms: int = QUIET_MS, cap_ms: int = SETTLE_CAP_MS, order: Sequence[str] = ORDER, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Stretches of activity per session that end in ``quiet_ms`` without a change and without an open request.

    ``df`` has ``kind``: ``dom``, ``request`` (opens), ``response`` or ``failed`` (close). A stretch longer than ``cap_ms``
    is marked as timed out.
    """
    step = F.when(F.col("kind") == "request", 1).when(F.col("kind").isin("response", "failed"), -1).otherwise(0)
    cut = slices(df, ["session"], order, rows_per_slice)
    first = ordered_scan(
        df, ["session"], order, cut, sums={"_open": step.cast("bigint")}, previous={"_before": F.col(order[0])}
    )
    # The quiet time counts only when nothing was open before this row.
    open_before = F.col("_open") - step
    starts = F.col("_before").isNull() | ((F.col(order[0]) - F.col("_before") >= quiet_ms) & (open_before <= 0))
    marked = first.withColumn("_start", F.when(starts, F.col(order[0])))
    placed = ordered_scan(marked, ["session"], order, cut, lasts={"started": F.col("_start")})
    return (
        placed.groupBy("session", "started")
        .agg(F.max(order[0]).alias("last"), F.count("*").alias("events"), F.count_if(F.col("kind") == "dom").alias("mutations"))
        .withColumn("settled", F.col("last") + quiet_ms)
        .withColumn("timed_out", F.col("settled") - F.col("started") > cap_ms)
    )


def detect_loops(df: DataFrame, keys: Sequence[str] = ("session",), order: Sequence[str] = ORDER, limit: int = 3, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Add ``repeat``, how often the same call has come in a row, and ``looped`` from the ``limit``-th on."""
    call = F.concat_ws("|", "verb", "args")
    cut = slices(df, keys, order, rows_per_slice)
    first = ordered_scan(df, keys, order, cut, sums={"_n": F.lit(1).cast("bigint")}, previous={"_before": call})
    change = F.col("_before").isNull() | (F.col("_before") != call)
    marked = first.withColumn("_change", F.when(change, F.col("_n")))
    out = ordered_scan(marked, keys, order, cut, lasts={"_since": F.col("_change")})
    out = out.withColumn("repeat", F.col("_n") - F.col("_since") + 1)
    return out.withColumn("looped", F.col("repeat") >= limit).drop("_n", "_before", "_change", "_since")


def recent_projects(opens: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` projects opened last, newest first."""
    return opens.groupBy("project").agg(F.max("t").alias("opened")).orderBy(F.desc("opened"), "project").limit(n)


def route_attribution(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Add the route of each ``path``: an exact pattern, else the longest ``/prefix/*``, else ``*.ext``, else NULL.

    The prefixes of a path become rows, so the match is an equi-join and works for any number of routes.
    """
    parts = F.split(F.col("path"), "/", -1)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/*"))
    )
    last = F.element_at(parts, -1)
    ext = F.when(F.contains(last, F.lit(".")), F.concat(F.lit("*."), F.substring_index(last, ".", -1)))
    asked = requests.select("path").distinct().select(
        "path", F.explode(F.array_compact(F.concat(F.array("path"), prefixes, F.array(ext)))).alias("pattern")
    )
    exact, prefix = F.col("pattern") == F.col("path"), F.col("pattern").endswith("/*")
    rank = F.struct(F.when(exact, 0).when(prefix, 1).otherwise(2), -F.length("pattern"), "pattern")
    best = asked.join(routes.select("pattern", "route").distinct(), "pattern").groupBy("path")
    found = best.agg(F.min_by(F.struct("pattern", "route"), rank).alias("_r"))
    return requests.join(found, "path", "left").select(*requests.columns, "_r.pattern", "_r.route")
